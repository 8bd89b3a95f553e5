"""Removal of repeated 50-byte strings with suffix arrays.

A byte goes if a 50-byte string over it also starts in a document with a smaller
doc_id. Every 50-byte string is named by the smallest hash of its 16-byte grams;
equal strings have equal names. Neighbouring strings of one name form a piece (84
bytes at most). So the work splits by name, without a global suffix array:

1. Texts are read in blocks of bounded size. Names found in one text of a block
   go to the name's shard (a block sends a name once, however many of its texts
   hold it); names that several texts of a block hold are known to repeat.
2. A shard tells which names stand in different texts; each text gets its list.
3. The first document of each text (exact copies follow it) cuts its pieces of
   repeated names. Equal pieces of a block are one; where a smaller document of
   the block has the same piece, the strings are decided on the spot. The pieces
   go to the shard of their name.
4. There the distinct pieces of a name are one small text; the grouping suffix
   sort (``suffix.py``) orders all their suffixes. Neighbours that share 50 bytes
   share a string; its smallest document keeps it. Pieces are halved before by
   the bytes beside the gram, so texts that share a gram only do not meet; a
   piece that meets no other needs no sort. A name with more than HOT strings is
   dealt by the pieces' bytes to all shards, and sorted there in parts of bounded
   size; what a part does not decide goes on by string, and the smallest document
   over all parts keeps it.
5. Spans come back to their text and are cut out.

What a block sends for a name does not grow with the copies in the block, texts
travel packed, and nothing is gathered per name beyond one entry per block.

Defined results: a null text is empty; texts under 50 bytes stay whole; a null id
is not smaller than any id: such rows neither lose nor cause anything; rows
repeated with one id do not remove each other; columns beside doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from textgraph.llm.common import shards
from textgraph.llm.suffix import ranges, suffix_order

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
PER_PARTITION = 2  # shards per shuffle partition, to even them out
BLOCK = 16 << 20  # bytes of text
SORTED_AT_ONCE = 1 << 17  # positions
HOT = 1 << 16  # strings of one name, counted upwards, that one shard takes

LOW_U = 0x7FFF  # of a text's second hash, beside the first, in what pieces carry
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(2).integers(0, 2**64, 256, dtype=np.uint64)
_DIGESTS = [
    (np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64), multiplier)
    for seed, multiplier in ((3, 0xD1342543DE82EF95), (4, 0xAF251AF3B0F025B5))
]


def _grams(raw: np.ndarray) -> np.ndarray:
    h = _BYTE[raw]
    for m in (1, 2, 4, 8):
        h = h[: len(h) - m] * np.uint64(pow(_MULTIPLIER, m, 2**64)) + h[m:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _names(raw: np.ndarray) -> np.ndarray:
    """The name of the string at each place: the least of its grams."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64)
    h = _grams(raw)
    for m in (1, 2, 4, 8, 16):
        h = np.minimum(h[: len(h) - m], h[m:])
    return np.minimum(h[: len(h) - (WINDOW - 32)], h[WINDOW - 32 :])


def _runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that are named by the same gram: name, start, size, and where the gram stands in the run.

    Of equal grams in a string the leftmost names it, so equal strings are named at the same place.
    """
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h = _grams(raw)
    at = np.arange(len(h), dtype=np.int32)
    for m in (1, 2, 4, 8, 16, WINDOW - 32):
        later = h[m:] < h[: len(h) - m]
        h = np.where(later, h[m:], h[: len(h) - m])
        at = np.where(later, at[m:], at[: len(at) - m])
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[heads, len(at)])
    return h[heads], heads, sizes, at[heads] - heads


def _digests(raw: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the string at each place."""
    out, n = [], len(raw) - LENGTH + 1
    for byte, multiplier in _DIGESTS:
        h = byte[raw]
        whole, done = np.zeros(n, np.uint64), 0
        for m in (1, 2, 4, 8, 16, 32):
            if LENGTH & m:  # 50 bytes are 2, 16 and 32
                whole = whole * np.uint64(pow(multiplier, m, 2**64)) + h[done : done + n]
                done += m
            if m < 32:
                h = h[: len(h) - m] * np.uint64(pow(multiplier, m, 2**64)) + h[m:]
        whole ^= whole >> np.uint64(31)
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(whole ^ (whole >> np.uint64(29)))
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    body = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.compress(body, 3)


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    body, at, out = zstandard.decompress(blob), 0, []
    for kind in types:
        size = int.from_bytes(body[at : at + 8], "little")
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _five(a: np.ndarray) -> np.ndarray:
    """The low five bytes of each number."""
    return np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _of_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


_LOW = np.uint64((1 << 40) - 1)


def _in_blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[list]]:
    """Rows in blocks of bounded bytes, column-wise."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[text] or "")
            if size >= BLOCK:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


def _meeting(into: int) -> tuple[int, int]:
    """Shards of strings and of texts after the sort: there is less to meet than pieces, and each shard sends to each."""
    return max(1, into // PER_PARTITION), max(1, into // (2 * PER_PARTITION))


def _cut(values: np.ndarray, into: int) -> list[tuple[int, np.ndarray]]:
    """Places of the values by their shard."""
    shard = (values % np.uint64(into)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(order) else []
    return [(int(shard[part[0]]), part) for part in np.split(order, heads[1:])] if len(order) else []


# more: to a name's shard, how many strings the first names have, others have WINDOW at most; to a text's, the hot names.
_ENTRY = "shard int, names binary, texts binary, more binary"
_ENTRIES = pa.schema([("shard", pa.int32()), ("names", pa.binary()), ("texts", pa.binary()), ("more", pa.binary())])


def _entries(into: int):
    """Per block: (name, text) of names in one text, text 0 for others; (text, name) of the others to the text's shard after ``into``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in _in_blocks(batches, 1):
            names, owners, strings, seen = [], [], [], set()
            for t, x in zip(key, text):
                if x is None or t in seen:
                    continue
                seen.add(t)
                found = _names(np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8))
                if len(found):
                    heads = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    own, which = np.unique(found[heads], return_inverse=True)
                    names.append(own)
                    owners.append(np.full(len(own), t & int(_LOW), np.uint64))
                    strings.append(np.bincount(which, np.diff(np.r_[heads, len(found)])).astype(np.int64))
            if not names:
                continue
            name, owner = np.concatenate(names), np.concatenate(owners)
            order = np.argsort(name)
            name, owner = name[order], owner[order]
            heads = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            times = np.diff(np.r_[heads, len(name)])
            single = np.where(times == 1, owner[heads], np.uint64(0))
            count = np.add.reduceat(np.concatenate(strings)[order], heads)
            rows = []
            for s, at in _cut(name[heads], into):
                at = np.r_[at[count[at] > WINDOW], at[count[at] <= WINDOW]]
                rows.append((s, _five(name[heads][at] // np.uint64(into)).tobytes(), _five(single[at]).tobytes(),
                             np.minimum(count[at[count[at] > WINDOW]], HOT + 1).astype(np.int32).tobytes()))
            many = np.repeat(times > 1, times)
            rows += [(into + s, _five(name[many][at]).tobytes(), _five(owner[many][at]).tobytes(), b"") for s, at in _cut(owner[many], into)]
            yield pa.RecordBatch.from_pydict(dict(zip(_ENTRIES.names, map(list, zip(*rows)))), _ENTRIES)

    return run


_ANSWER = "text long, names binary, hot binary"
_ANSWERS = pa.schema([("text", pa.int64()), ("names", pa.binary()), ("hot", pa.binary())])


def _repeated(into: int):
    """(text, name) of the names that stand in different texts, by shard of the text; known ones pass. All shards of texts get the hot names."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        if shard >= into:
            return table
        texts = _of_five(b"".join(table["texts"].to_pylist()))
        names = _of_five(b"".join(table["names"].to_pylist()))
        count, at = np.full(len(names), WINDOW), 0
        for known, some in zip(table["names"].to_pylist(), table["more"].to_pylist()):
            count[at : at + len(some) // 4] = np.frombuffer(some, np.int32)
            at += len(known) // 5
        order = np.lexsort((texts, names))
        names, texts = names[order], texts[order]
        heads = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        last = np.r_[heads[1:], len(names)] - 1
        # Different texts: two numbers differ, or a block had several (0).
        repeated = (texts[heads] != texts[last]) | (texts[heads] == 0)
        keep = np.repeat(repeated, last + 1 - heads) & (texts > 0)
        keep &= np.r_[True, (names[1:] != names[:-1]) | (texts[1:] != texts[:-1])]
        hot = names[heads[np.add.reduceat(count[order], heads) > HOT]] * np.uint64(into) + np.uint64(shard)
        names, texts = names[keep] * np.uint64(into) + np.uint64(shard), texts[keep]
        rows = [(into + s, _five(names[at]).tobytes(), _five(texts[at]).tobytes(), b"") for s, at in _cut(texts, into)]
        if len(hot):
            rows += [(into + s, b"", b"", _five(hot).tobytes()) for s in range(into)]
        return pa.Table.from_pydict(dict(zip(_ENTRIES.names, map(list, zip(*rows)) if rows else [[]] * 4)), _ENTRIES)

    return run


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    """Per text the low bytes of its repeated names, and of the hot ones among them."""
    texts, names, often = (_of_five(b"".join(table[c].to_pylist())) for c in ("texts", "names", "more"))
    if not len(texts):
        return _ANSWERS.empty_table()
    order = np.lexsort((names, texts))
    texts, names = texts[order], names[order]
    new = np.r_[True, (texts[1:] != texts[:-1]) | (names[1:] != names[:-1])]
    texts, names = texts[new], names[new]
    raw, hot = _five(names).tobytes(), np.isin(names, often)
    heads = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
    stops = np.r_[heads[1:], len(texts)]
    return pa.Table.from_pydict({
        "text": texts[heads].astype(np.int64), "names": [raw[5 * a : 5 * b] for a, b in zip(heads.tolist(), stops.tolist())],
        "hot": [_five(names[a:b][hot[a:b]]).tobytes() for a, b in zip(heads.tolist(), stops.tolist())],
    }, _ANSWERS)


_PIECE = "shard int, pieces binary"
_PIECES = pa.schema([("shard", pa.int32()), ("pieces", pa.binary())])


def _pieces(into: int):
    """The pieces of repeated names of a block's texts, by shard of their name, of hot names by that of their bytes; decided spans to shards after ``into``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, t, u, packed, known, often in _unzipped(batches):
            parts, rows = [], []
            for n, (text, own, frequent) in enumerate(zip(packed, known, often)):
                found = _runs(np.frombuffer(text, np.uint8))
                kept = np.flatnonzero(np.isin(found[0] & _LOW, _of_five(own)))
                parts.append([*(f[kept] for f in found), np.isin(found[0][kept] & _LOW, _of_five(frequent))])
                rows.append(np.full(len(kept), n))
            name, start, size, gram, hot = map(np.concatenate, zip(*parts))
            row = np.concatenate(rows)
            if not len(name):
                continue
            ids, first, second = np.array(doc_id, np.int64), np.array(t, np.int64), np.array(u, np.int64)
            # Equal pieces of the block: the smallest document's go on, the others' strings are repeated.
            smallest: dict[bytes, int] = {}
            contents = [packed[n][a:b] for n, a, b in zip(row.tolist(), start.tolist(), (start + size + LENGTH - 1).tolist())]
            for piece, d in zip(contents, ids[row].tolist()):
                if smallest.setdefault(piece, d) > d:
                    smallest[piece] = d
            keeps = np.fromiter(map(smallest.__getitem__, contents), np.int64, len(contents)) == ids[row]
            out = []
            dealt = name.copy()
            for k in np.flatnonzero(hot).tolist():
                dealt[k] = zlib.crc32(contents[k])
            for s, at in _cut(dealt, into):
                at = at[keeps[at]]
                if len(at):
                    out.append((s, _packed(
                        _five(name[at] // np.uint64(into)), ids[row[at]], first[row[at]], (second[row[at]] & LOW_U).astype(np.int16),
                        start[at].astype(np.int32), size[at].astype(np.uint8), gram[at].astype(np.uint8), hot[at].astype(np.uint8),
                        np.frombuffer(b"".join([contents[k] for k in at.tolist()]), np.uint8))))
            gone = np.flatnonzero(~keeps)
            for s, at in _cut(first[row[gone]].view(np.uint64), _meeting(into)[1]):
                at = gone[at]
                out.append((into + s, _packed(
                    first[row[at]], (second[row[at]] & LOW_U).astype(np.int16), start[at].astype(np.int64), start[at] + size[at] + LENGTH - 1)))
            yield pa.RecordBatch.from_pydict(dict(zip(_PIECES.names, map(list, zip(*out)))), _PIECES)

    return run


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            text = zstandard.decompress(row[3])
            held.append((*row[:3], text, *row[4:]))
            size += len(text)
            if size >= BLOCK:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


_SPAN = "t long, u short, spans binary"
_SPANS = pa.schema([("t", pa.int64()), ("u", pa.int16()), ("spans", pa.binary())])


def _joined_spans(t: np.ndarray, u: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """One row per text: its spans, those that touch as one."""
    if not len(t):
        return _SPANS.empty_table()
    order = np.lexsort((end, begin, u, t))
    t, u, begin, end = t[order], u[order], begin[order], end[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (u[1:] != u[:-1])]
    text = np.cumsum(new) - 1
    # Running ends per text: texts are laid behind each other.
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + text * room)
    apart = np.r_[True, begin[1:] + text[1:] * room > reach[:-1]]
    heads = np.flatnonzero(apart)
    begin, end = begin[heads], reach[np.r_[heads[1:] - 1, len(t) - 1]] - text[heads] * room
    texts = np.flatnonzero(np.r_[True, text[heads][1:] != text[heads][:-1]])
    spans = np.stack([begin, end], axis=1).astype(np.int64)
    return pa.Table.from_pydict({
        "t": t[heads][texts], "u": u[heads][texts], "spans": [s.tobytes() for s in np.split(spans, texts[1:])]}, _SPANS)


SHARED = GRAM + WINDOW // 2  # bytes that the strings of one half share


def _halves(name, size, gram, content, offsets):
    """Pieces cut in two by where the gram stands: parent, first string, strings, key.

    The strings of a half share their gram and the SHARED - GRAM bytes behind it
    (or before it), so halves that differ there have no string in common.
    """
    after = np.maximum(gram - (WINDOW // 2 - 1), 0)  # strings from here on hold the bytes behind the gram
    behind = np.flatnonzero(after < size)
    before = np.flatnonzero(after > 0)
    parent = np.r_[behind, before]
    first = np.r_[after[behind], np.zeros(len(before), np.int64)]
    count = np.r_[size[behind] - after[behind], np.minimum(after, size)[before]]
    place = np.r_[offsets[behind] + gram[behind], offsets[before] + gram[before] - WINDOW // 2]
    key = name[parent] * np.uint64(2) + np.r_[np.zeros(len(behind), np.uint64), np.ones(len(before), np.uint64)]
    for k in range(SHARED):
        key = key * np.uint64(_MULTIPLIER) + _BYTE[content[place + k]]
    return parent, first, count, key


def repeated_strings(name, doc, size, gram, content, hot) -> np.ndarray:
    """For each string of the pieces, one piece after the other: whether a smaller document has it too.

    Pieces of ``hot`` names are compared within parts of SORTED_AT_ONCE positions only.

    ``size``: strings per piece; ``gram``: where the naming gram stands in the
    piece; ``content``: the pieces' bytes. Halves that share what their strings
    must share are sorted as one small text.
    """
    offsets = np.r_[0, np.cumsum(size + LENGTH - 1)]
    string_at = np.r_[0, np.cumsum(size)]
    flags = np.zeros(int(string_at[-1]), bool)
    parent, first, count, key = _halves(name, size, gram, content, offsets[:-1])
    key = key * np.uint64(2) + hot[parent]
    order = np.argsort(key, kind="stable")
    parent, first, count, key = parent[order], first[order], count[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    before = np.cumsum(count + LENGTH) - (count + LENGTH)
    part = (before - np.maximum.accumulate(np.where(new, before, 0))) // SORTED_AT_ONCE
    new[1:] |= (part[1:] != part[:-1]) & hot[parent[1:]].astype(bool)
    heads = np.flatnonzero(new)
    number = np.diff(np.r_[heads, len(key)])
    heads, number = heads[number > 1], number[number > 1]  # one piece alone shares nothing
    if not len(heads):
        return flags
    lengths = count + LENGTH  # with a separator before
    sums = np.r_[0, np.cumsum(lengths)]
    total = sums[heads + number] - sums[heads]
    by_size = np.argsort(total, kind="stable")  # texts of like size are sorted together
    cuts = np.flatnonzero(np.diff(np.cumsum(total[by_size]) // SORTED_AT_ONCE)) + 1
    for some in np.split(by_size, cuts):
        piece, text = ranges(heads[some], number[some])
        ends = np.cumsum(lengths[piece])
        begins = ends - lengths[piece] + 1  # behind the separator
        data, separator = np.zeros(int(ends[-1]) + 8, np.uint8), np.zeros(int(ends[-1]), bool)
        separator[begins - 1] = True
        source, owner = ranges(offsets[parent[piece]] + first[piece] - 1, lengths[piece])
        source[begins - 1] = 0
        data[: len(source)] = content[source]
        data[begins - 1] = 0
        order = suffix_order(data[: len(separator)], separator, text[owner], len(some))
        order = order[(ends[owner[order]] - order >= LENGTH) & ~separator[order]].astype(np.int64)
        words = np.ndarray((len(separator),), "<u8", data, 0, (1,))
        same = text[owner[order[1:]]] == text[owner[order[:-1]]]
        for skip in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            w = words[order + skip]
            same &= w[1:] == w[:-1]
        strings = np.flatnonzero(np.r_[True, ~same])
        holder = doc[parent[piece]][owner[order]]
        least = np.repeat(np.minimum.reduceat(holder, strings), np.diff(np.r_[strings, len(order)]))
        place = order[least < holder]
        p = piece[owner[place]]
        flags[string_at[parent[p]] + first[p] + place - begins[owner[place]]] = True
    return flags


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(_PIECES.names, map(list, zip(*rows)) if rows else [[]] * 2)), _PIECES)


def _spans_of(into: int):
    """The spans to remove that one shard decides, to shards of texts after ``into``; open strings of hot names to the string's shard."""

    strings, texts = _meeting(into)

    def spans(t, u, begin, end):
        return [(into + s, _packed(t[at], u[at], begin[at].astype(np.int64), end[at].astype(np.int64))) for s, at in _cut(t.view(np.uint64), texts)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= into:
            parts = [_unpacked(b, np.int64, np.int16, np.int64, np.int64) for b in table["pieces"].to_pylist()]
            return _table(spans(*(np.concatenate(c) for c in zip(*parts))))
        kinds = (np.uint8, np.int64, np.int64, np.int16, np.int32, np.uint8, np.uint8, np.uint8, np.uint8)
        parts = [_unpacked(b, *kinds) for b in table["pieces"].to_pylist()]
        name, doc, t, u, start, size, gram, hot, raw = (np.concatenate(c) for c in zip(*parts))
        name, start, size, gram = _of_five(name.tobytes()), *(a.astype(np.int64) for a in (start, size, gram))
        lengths = size + LENGTH - 1
        offsets = np.r_[0, np.cumsum(lengths)]
        whole = raw.tobytes()
        # Equal pieces are one, of their smallest document.
        distinct: dict[bytes, int] = {}
        contents = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        which = np.array([distinct.setdefault(c, len(distinct)) for c in contents])
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        sample = np.empty(len(distinct), np.int64)
        sample[which] = np.arange(len(which))
        flags = repeated_strings(name[sample], least, size[sample], gram[sample], np.frombuffer(b"".join(distinct), np.uint8), hot[sample])
        string_at = np.cumsum(size[sample]) - size[sample]
        repeated = doc > least[which]
        touched = np.flatnonzero(np.add.reduceat(flags, string_at, dtype=np.int64)[which].astype(bool) & ~repeated)
        # The flagged strings of the touched pieces, as runs.
        place, owner = ranges(string_at[which[touched]], size[touched])
        on = flags[place]
        edge = np.r_[True, owner[1:] != owner[:-1]]
        begin = np.flatnonzero(on & (edge | ~np.r_[False, on[:-1]]))
        end = np.flatnonzero(on & (np.r_[edge[1:], True] | ~np.r_[on[1:], False]))
        base = start[touched] - string_at[which[touched]]
        k = np.r_[np.flatnonzero(repeated), touched[owner[begin]]]
        begins = np.r_[start[repeated], base[owner[begin]] + place[begin]]
        ends = np.r_[(start + lengths)[repeated], base[owner[end]] + place[end] + LENGTH]
        out = spans(t[k], u[k], begins, ends)
        # Strings of hot names that no other piece here decides; bytes are hashed in slices.
        open_ = []
        still = np.flatnonzero(hot.astype(bool) & ~repeated)
        for some in np.split(still, np.flatnonzero(np.diff(np.cumsum(lengths[still]) // SORTED_AT_ONCE)) + 1):
            if not len(some):
                continue
            bytes_at, _ = ranges(offsets[some], lengths[some])
            one, two = _digests(raw[bytes_at])
            place, owner = ranges(np.cumsum(lengths[some]) - lengths[some], size[some])
            in_piece = place - (np.cumsum(lengths[some]) - lengths[some])[owner]
            free = np.flatnonzero(~flags[string_at[which[some]][owner] + in_piece])
            one, two, k, begin = one[place[free]], two[place[free]], some[owner[free]], in_piece[free]
            open_.append((one, two, doc[k], t[k], u[k], (start[k] + begin).astype(np.int32)))
        if open_:
            found = [np.concatenate(c) for c in zip(*open_)]
            out += [(s, _packed(*(f[at] for f in found))) for s, at in _cut(found[0], strings)]
        return _table(out)

    return run


def _merged(into: int):
    """Spans by text: those that were decided, and open strings that a smaller document has in another part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table["pieces"].to_pylist()
        if key[0].as_py() >= into:
            parts = [_unpacked(b, np.int64, np.int16, np.int64, np.int64) for b in blobs]
            return _joined_spans(*(np.concatenate(c) for c in zip(*parts)))
        parts = [_unpacked(b, np.uint64, np.uint64, np.int64, np.int64, np.int16, np.int32) for b in blobs]
        one, two, doc, t, u, start = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((two, one))
        one, two, doc = one[order], two[order], doc[order]
        heads = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.r_[heads, len(doc)]))
        gone = order[doc > least]
        begin = start[gone].astype(np.int64)
        return _joined_spans(t[gone], u[gone], begin, begin + LENGTH)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        doc_id, text, t, u = batch.columns
        packed = [press.compress((x or "").encode("utf-8", "surrogatepass")) for x in text.to_pylist()]
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(packed, pa.binary()), t, u], names=["doc_id", "packed", "t", "u"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULTS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("kept", pa.binary()),
])


def _removed(with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, packed, first, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = zstandard.decompress(packed)
                cut: list[tuple[int, int]] = []
                if doc_id is not None and len(raw) >= LENGTH:
                    if doc_id > first:
                        cut = [(0, len(raw))]
                    elif spans:
                        found = np.concatenate([np.frombuffer(s, np.int64) for s in spans]).reshape(-1, 2)
                        for a, b in sorted(map(tuple, found.tolist())):
                            if cut and a <= cut[-1][1]:
                                cut[-1] = (cut[-1][0], max(b, cut[-1][1]))
                            else:
                                cut.append((a, b))
                kept, at = [], 0
                for a, b in cut:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left if with_texts else None))
            yield pa.RecordBatch.from_pydict(dict(zip(_RESULTS.names, map(list, zip(*out)) if out else [[]] * 6)), _RESULTS)

    return run


def _dealt(rows: DataFrame, packed: DataFrame, classes: DataFrame, into: int) -> DataFrame:
    """The pieces, by shard."""
    entries = rows.filter("doc_id IS NOT NULL").select("t", "text").mapInArrow(_entries(into), _ENTRY)
    answers = entries.groupBy("shard").applyInArrow(_repeated(into), _ENTRY).groupBy("shard").applyInArrow(_answers, _ANSWER)
    low = F.col("t").bitwiseAND(F.lit(int(_LOW)))
    asked = classes.withColumn("text", low).join(answers, "text").select("t", "u", "first", "names", "hot")
    firsts = packed.join(asked, ["t", "u"]).filter("doc_id = first").select("doc_id", "t", "u", "packed", "names", "hot")
    return firsts.mapInArrow(_pieces(into), _PIECE)


def _prepared(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with two hashes of their text, the same with packed texts, and the first document of each text."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64(F.lit(1), "text").alias("t"), F.xxhash64(F.lit(2), "text").alias("u"))
    classes = rows.filter("doc_id IS NOT NULL").groupBy("t", "u").agg(F.min("doc_id").alias("first"))
    packed = rows.select("doc_id", "text", "t", "u").mapInArrow(_pack, "doc_id long, packed binary, t long, u long")
    return rows, packed, classes


def remove_repeats(documents: DataFrame, with_texts: bool = False) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and ``kept`` with_texts (else null)."""
    into = PER_PARTITION * shards(documents.sparkSession)
    rows, packed, classes = _prepared(documents)
    pieces = _dealt(rows, packed, classes, into)
    spans = pieces.groupBy("shard").applyInArrow(_spans_of(into), _PIECE).groupBy("shard").applyInArrow(_merged(into), _SPAN)
    spans = spans.groupBy("t", F.col("u").alias("low_u")).agg(F.collect_list("spans").alias("spans"))  # of one text
    judged = classes.withColumn("low_u", F.col("u").bitwiseAND(F.lit(LOW_U)).cast("short")).join(spans, ["t", "low_u"], "left").drop("low_u")
    whole = packed.join(judged, ["t", "u"], "left").select("doc_id", "packed", "first", "spans")
    return whole.mapInArrow(_removed(with_texts), RESULT)
