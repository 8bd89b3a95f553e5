"""Cross-tokenizer alignment with inverted pair bitmaps.

A document is space+text in two tokenizers. Byte offsets where tokens of both end
cut it into groups; tokens whose bytes overlap are linked. The count of a pair of
ids is the number of documents that hold it linked.

1. Texts are cut into units at single spaces between other characters. The byte
   tokenizer's expression starts a token there, and no piece of the other has a
   space mark behind another character (checked when it is loaded), so no merge
   reaches across: tokens, groups and links of a text are those of its units, and
   a task aligns each distinct unit it meets once, while it remembers it.
2. Documents are numbered by segment and slot. A task holds links until they are
   many, then writes a posting per pair: the slots that hold it, compressed (two
   bytes a slot up to 4,096 of them, beyond that one bit for each of the 65,536),
   and planes of the bits of multiplicity - 1 over these slots.
3. Postings of one pair and segment are OR-merged, their planes added. Popcounts
   give documents, popcounts of the planes links; both are summed by pair.
4. The counts meet the postings, which return them: a segment's postings add
   count x multiplicity, and the links whose count is the highest of their A id,
   to the slots. A segment stands in one task, with two numbers a slot.

A pair in all documents is one small posting per segment, so none is hot. Pair
counts (at most vocabulary x vocabulary) are broadcast where they measure at most
``Limits.broadcast`` bytes; beyond that postings are shuffled to them and back.

Defined results: a text that is null, empty, or not given back byte by byte by
both tokenizers has no tokens: zeros and an empty text. Rows repeated with one id
are documents of their own; null ids stay. Texts are read in slices of about
``Limits.slice`` characters; a text without a place to cut is one slice. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgraph.functions.joins import table_bytes
from textgraph.session import run_folder, stage

CUT = re.compile(r"(?<=\S) (?=\S)")
LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Limits:
    """What bounds a task's memory; the rows are the same for all values."""

    slice: int = 1 << 20  # characters of a text read at once
    slots: int = 1 << 16  # documents of a segment, at most 2^16
    array: int = 4096  # slots that a posting lists; beyond, one bit for each
    held: int = 1 << 21  # links held until they become postings
    segment: int = 1 << 23  # links after which a segment is closed
    units: int = 1 << 19  # units remembered
    unit_links: int = 1 << 23  # links of these
    broadcast: int = 64 * 1024 * 1024  # bytes of pair counts


LIMITS = Limits()

ROW = (
    "kind string, segment long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "pair long, documents int, docs binary, planes binary"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_ROWS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ROW.split(", ")])
_MERGED = "segment long, pair long, documents int, links long, docs binary, planes binary"
_MERGEDS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _MERGED.split(", ")])
_SCORED = "segment long, slot int, n_best long, count_sum long"
_SCOREDS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _SCORED.split(", ")])


def _byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes are their own, others go up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(other)}}


class _Loaded:
    """Both tokenizers, the bytes of their tokens, and ids as text with what may follow them."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = _byte_of_letter()
        self.bytes_a = {
            n: bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry, n in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: a piece with a space behind another character; units cannot be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        most = max(max(self.bytes_a) + 1, len(pieces))
        self.size_a = np.array([len(self.bytes_a.get(n, b"")) for n in range(most)], np.int64)
        self.size_b = np.array([len(p) for p in self.bytes_b], np.int64)
        self.text_comma, self.text_bar, self.text_end = (np.array([f"{n}{c}" for n in range(most)], object) for c in ",|;")


@lru_cache(maxsize=1)
def _loaded(path_a: str, path_b: str) -> _Loaded:
    return _Loaded(path_a, path_b)


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """What two tokenizations of the same bytes have in common.

    For each token of A how many of B overlap it, and these pairs as ``a * 2^32 + b``; for each token of both whether a
    group ends with it; the place of each token where A's tokens of a group come before B's.
    """
    until = np.searchsorted(ends_b, ends_a)  # the token of B that holds A's last byte
    begin = np.searchsorted(ends_b, np.r_[0, ends_a[:-1]], "right")
    n = until - begin + 1
    pairs = np.repeat(a, n) << 32 | b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)]
    cut_a, cut_b = ends_b[until] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    before_b = np.r_[0, np.cumsum(np.bincount(group_b))]
    upto_a = np.cumsum(np.bincount(group_a))
    return n, pairs, cut_a, cut_b, np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]


class Units:
    """The units a task remembers, by number: tokens of both kinds, groups, links; whether both give the bytes back."""

    def __init__(self, path_a: str, path_b: str, limits: Limits = LIMITS) -> None:
        self.limits, self.known = limits, _loaded(path_a, path_b)
        self.a, self.b = self.known.a, self.known.b
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs = (array("q") for _ in range(5))
        self.groups: list[str] = []
        self.good: list[bool] = []

    def full(self) -> bool:
        return len(self.number) > self.limits.units or len(self.pairs) > self.limits.unit_links

    def learn(self, units: list[str]) -> None:
        # Units without white space at their ends, one after another, are a text that is cut into just these.
        clean = [u for u in units if u and not u[0].isspace() and not u[-1].isspace()]
        if clean and not self._learn_joined(clean):
            clean = []
        if len(clean) < len(units):
            known = set(clean)
            self._learn_each([u for u in units if u not in known])

    def _learn_joined(self, units: list[str]) -> bool:
        """Units by one call; not if the tokenizers do not give the bytes back, since it is open then for which unit."""
        text = " ".join(units)
        raw = (" " + text).encode()
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if b"".join(map(self.known.bytes_b.__getitem__, b)) != raw or b"".join(map(self.known.bytes_a.__getitem__, a)) != raw:
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        ends_a, ends_b = np.cumsum(self.known.size_a[a]), np.cumsum(self.known.size_b[b])
        self._add(units, a, ends_a, np.diff(np.searchsorted(ends_a, ends) + 1, prepend=0), b, ends_b, np.diff(np.searchsorted(ends_b, ends) + 1, prepend=0))
        return True

    def _learn_each(self, units: list[str]) -> None:
        spaced = [" " + u for u in units]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        bytes_a, bytes_b, good = self.known.bytes_a, self.known.bytes_b, []
        for whole, a, b in zip(spaced, ids_a, ids_b):
            raw = whole.encode()
            good.append(b"".join([bytes_b[t] for t in b]) == raw and b"".join([bytes_a[t] for t in a]) == raw)
        if any(good):
            a, b = (np.array(list(chain.from_iterable(compress(ids, good))), np.int64) for ids in (ids_a, ids_b))
            n_a, n_b = (np.array(list(map(len, compress(ids, good)))) for ids in (ids_a, ids_b))
            self._add(list(compress(units, good)), a, np.cumsum(self.known.size_a[a]), n_a, b, np.cumsum(self.known.size_b[b]), n_b)
        bad = [u for u, g in zip(units, good) if not g]
        if bad:
            self._named(bad, False, np.zeros((4, len(bad)), np.int64), [""] * len(bad))

    def _add(self, units: list[str], a: np.ndarray, ends_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> None:
        """Both tokenizations of units one after another: they cover the same bytes and end together with each unit."""
        n, pairs, cut_a, cut_b, place_a, place_b = aligned(a, ends_a, b, ends_b)
        first = np.cumsum(n_a) - n_a
        sizes = np.stack([n_a, n_b, np.add.reduceat(cut_a.astype(np.int64), first), np.add.reduceat(n, first)])
        text = np.empty(len(a) + len(b), object)
        text[place_a] = np.where(cut_a, self.known.text_bar[a], self.known.text_comma[a])
        text[place_b] = np.where(cut_b, self.known.text_end[b], self.known.text_comma[b])
        text, end = text.tolist(), np.cumsum(n_a + n_b).tolist()
        self.pairs.frombytes(pairs.tobytes())
        self._named(units, True, sizes, ["".join(text[x:y])[:-1] for x, y in zip([0, *end], end)])

    def _named(self, units: list[str], good: bool, sizes: np.ndarray, groups: list[str]) -> None:
        self.number.update(zip(units, range(len(self.good), len(self.good) + len(units))))
        self.good += [good] * len(units)
        self.groups += groups
        for column, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links), sizes):
            column.frombytes(values.astype(np.int64).tobytes())

    def numbers(self, text: str) -> list[int]:
        units = CUT.split(text)
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if new:
            self.learn(new)
        return [self.number[u] for u in units]


def slices(text: str, size: int) -> Iterator[str]:
    """The text, cut at single spaces into slices; the spaces at the cuts belong to the slice that follows."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def encoded(starts: np.ndarray, slots: np.ndarray, times: np.ndarray, limits: Limits = LIMITS) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Documents, bitmaps and planes of postings; a posting's slots rise from its start."""
    ends = np.r_[starts[1:], len(slots)]
    raw, docs, planes = slots.astype("<u2").tobytes(), [], []
    several = np.maximum.reduceat(times, starts) > 1
    for a, b, more in zip(starts.tolist(), ends.tolist(), several.tolist()):
        if b - a <= limits.array:
            docs.append(raw[2 * a : 2 * b])
        else:
            bits = np.zeros(limits.slots, np.uint8)
            bits[slots[a:b]] = 1
            docs.append(np.packbits(bits, bitorder="little").tobytes())
        if more:
            rest = times[a:b] - 1
            planes.append(b"".join(
                np.packbits((rest >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(int(rest.max()).bit_length())))
        else:
            planes.append(b"")
    return (ends - starts).astype(np.int32), docs, planes


def decoded(documents: int, docs: bytes, planes: bytes, limits: Limits = LIMITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their multiplicities."""
    if documents <= limits.array:
        slots = np.frombuffer(docs, "<u2").astype(np.int64)
    else:
        slots = np.flatnonzero(np.unpackbits(np.frombuffer(docs, np.uint8), bitorder="little"))
    times, width = np.ones(documents, np.int64), -(-documents // 8)
    for k in range(len(planes) // width):
        plane = np.frombuffer(planes, np.uint8, width, k * width)
        times += np.unpackbits(plane, count=documents, bitorder="little").astype(np.int64) << k
    return slots, times


def links_of(documents: int, planes: bytes) -> int:
    """Popcount of the slots and, by weight, of the planes."""
    width = -(-documents // 8)
    return documents + sum(
        int(np.bitwise_count(np.frombuffer(planes, np.uint8, width, k * width)).sum()) << k for k in range(len(planes) // width))


def _filled(n: int, kind: str, **columns) -> pa.RecordBatch:
    """Rows with null in the columns that are not given."""
    given = {"kind": pa.array([kind] * n, pa.string()), **columns}
    return pa.RecordBatch.from_arrays(
        [given[f.name] if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type)
         for f in _ROWS], schema=_ROWS)


class _Segments:
    """Numbers documents and holds their links until they are written as postings."""

    def __init__(self, units: Units, keep: bool) -> None:
        self.units, self.keep, self.limits = units, keep, units.limits
        self.base, self.made = TaskContext.get().partitionId() << 32, 0
        self.slot = self.links = self.segment_links = 0
        self.held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def document(self, doc_id: int | None, text: str | None) -> Iterator[pa.RecordBatch]:
        """Postings that became due; the document's own row goes to ``self.row``."""
        if self.slot == self.limits.slots or self.segment_links > self.limits.segment:
            yield from self.postings()
            self.made, self.slot, self.segment_links = self.made + 1, 0, 0
        sums, digest, parts, known = [0, 0, 0, 0], hashlib.sha256(), [], self.units
        for n, numbers in enumerate((yield from self._pieces(text)) if text else ()):
            if callable(numbers):
                numbers = numbers()
            own, times = np.unique(np.array(numbers, np.int64), return_counts=True)
            counts = [int((np.frombuffer(column, np.int64)[own] * times).sum()) for column in (known.n_a, known.n_b, known.n_groups, known.n_links)]
            sums = [x + y for x, y in zip(sums, counts)]
            groups = (";" if n else "") + ";".join(map(known.groups.__getitem__, numbers))
            digest.update(groups.encode())
            if self.keep:
                parts.append(groups)
            self.held.append((self.slot, own, times))
            self.links += int(np.frombuffer(known.n_links, np.int64)[own].sum())
            if self.links > self.limits.held or known.full():
                yield from self.postings()
        self.segment_links += sums[3]
        self.row = (
            self.base + self.made, self.slot, doc_id, *sums, "".join(parts) if self.keep else None, digest.hexdigest() if sums[0] else "")
        self.slot += 1

    def _pieces(self, text: str):
        """The numbers of the units of each slice, made when they are due; none if a tokenizer does not give the text's
        bytes back. That has to be known of all slices before anything is held."""
        pieces, numbers = list(slices(text, self.limits.slice)), []
        for piece in pieces:
            if self.units.full():
                yield from self.postings()
            numbers = self.units.numbers(piece)
            if not all(map(self.units.good.__getitem__, numbers)):
                return []
        return [numbers] if len(pieces) == 1 else [partial(self.units.numbers, piece) for piece in pieces]

    def postings(self) -> Iterator[pa.RecordBatch]:
        """What is held, as postings of the segment; units are forgotten only here, since what is held names them."""
        if self.held:
            units = np.concatenate([own for _, own, _ in self.held])
            times = np.concatenate([t for _, _, t in self.held])
            slot = np.repeat([s for s, _, _ in self.held], [len(own) for _, own, _ in self.held])
            sizes = np.array(self.units.n_links)
            pairs, place = np.unique(np.array(self.units.pairs), return_inverse=True)
            n = sizes[units]
            at = np.repeat((np.cumsum(sizes) - sizes)[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            slots = self.limits.slots
            key = place[at] * slots + np.repeat(slot, n)
            order = np.argsort(key, kind="stable")
            key, times = key[order], np.repeat(times, n)[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, times = key[first], np.add.reduceat(times, first)
            starts = np.flatnonzero(np.r_[True, key[1:] // slots != key[:-1] // slots])
            documents, docs, planes = encoded(starts, key % slots, times, self.limits)
            yield _filled(
                len(starts), "posting", segment=np.full(len(starts), self.base + self.made), pair=pairs[key[starts] // slots],
                documents=documents, docs=docs, planes=planes)
        self.held, self.links = [], 0
        if self.units.full():
            self.units.clear()


def _index(path_a: str, path_b: str, keep: bool, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _Segments(Units(path_a, path_b, limits), keep)
        names = ["segment", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                yield from segments.document(doc_id.as_py(), text.as_py())
                rows.append(segments.row)
            if rows:
                yield _filled(len(rows), "document", **dict(zip(names, map(list, zip(*rows)))))
        yield from segments.postings()

    return run


def _merged(limits: Limits):
    """OR-merge postings that come in order of segment and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # postings of the last key: (segment, pair, documents, docs, planes)

        def closed(rows: list[tuple]) -> tuple:
            segment, pair, documents, docs, planes = rows[0]
            if len(rows) > 1:
                slots, times = map(np.concatenate, zip(*(decoded(*r[2:], limits) for r in rows)))
                own, place = np.unique(slots, return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, place, times)
                (documents,), (docs,), (planes,) = encoded(np.zeros(1, np.int64), own, total, limits)
            return segment, pair, int(documents), links_of(int(documents), planes), docs, planes

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and open_[0][:2] != row[:2]:
                    out.append(closed(open_))
                    open_ = []
                open_.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MERGEDS)], schema=_MERGEDS)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(closed(open_), _MERGEDS)], schema=_MERGEDS)

    return run


def _returned(limits: Limits):
    """Sums per slot from postings that come by segment: ``segment, documents, docs, planes, score, best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        sums, best = np.zeros(limits.slots, np.int64), np.zeros(limits.slots, np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(sums[at])], schema=_SCOREDS)

        def add(documents: np.ndarray, docs: list, planes: list, score: np.ndarray, is_best: np.ndarray) -> None:
            plain = np.array([not p for p in planes]) & (documents <= limits.array)
            slots = np.frombuffer(b"".join(d for d, p in zip(docs, plain.tolist()) if p), "<u2").astype(np.int64)
            np.add.at(sums, slots, np.repeat(score[plain], documents[plain]))
            np.add.at(best, slots[np.repeat(is_best[plain], documents[plain])], 1)
            for n in np.flatnonzero(~plain).tolist():
                slots, times = decoded(int(documents[n]), docs[n], planes[n], limits)
                sums[slots] += score[n] * times
                if is_best[n]:
                    best[slots] += times

        for batch in batches:
            segment = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and now != segment[a]:
                    yield out()
                    sums[:], best[:] = 0, 0
                now = int(segment[a])
                part = batch.slice(a, b - a)
                add(part.column(1).to_numpy(), part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_numpy(),
                    part.column(5).to_numpy(zero_copy_only=False))
        if now is not None:
            yield out()

    return run


class Alignment:
    """Written tables: documents with their own numbers, postings, and pair scores."""

    def __init__(self, documents: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, limits: Limits = LIMITS) -> None:
        self.limits = limits
        spark = documents.sparkSession
        self.folder = run_folder(spark, "alignment")
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        index = texts.mapInArrow(_index(path_a, path_b, keep_groups, limits), ROW)
        index.write.partitionBy("kind").parquet(f"{self.folder}/index")  # one pass over the texts gives both
        rows = spark.read.schema(index.schema).parquet(f"{self.folder}/index")
        self.documents = rows.filter("kind = 'document'").select(
            "segment", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256")
        parts = rows.filter("kind = 'posting'").select("segment", "pair", "documents", "docs", "planes")
        sorted_ = parts.repartition("segment").sortWithinPartitions("segment", "pair")
        self.postings = stage(sorted_.mapInArrow(_merged(limits), _MERGED), f"{self.folder}/postings")

    def pairs(self) -> DataFrame:
        """``pair, a, b, documents, links, best``: corpus-wide counts; best: no pair of the A id is in more documents."""
        counts = self.postings.groupBy("pair").agg(F.sum("documents").cast("long").alias("documents"), F.sum("links").alias("links"))
        counts = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(LOW)))
        most = F.max("documents").over(Window.partitionBy("a"))  # as many rows as ids B has, at most
        return counts.select("pair", "a", "b", "documents", "links", (F.col("documents") == most).alias("best"))

    def scores(self) -> DataFrame:
        """Every document with ``n_best`` and ``count_sum``, returned by the postings."""
        known = stage(self.pairs().select("pair", F.col("documents").alias("score"), "best"), f"{self.folder}/pairs")
        columns = ["segment", "documents", "docs", "planes", "score", "best"]
        if table_bytes(known) <= self.limits.broadcast:
            scored = self.postings.join(F.broadcast(known), "pair").select(*columns)
        else:
            scored = self.postings.join(known, "pair").select(*columns).repartition("segment").sortWithinPartitions("segment")
        slots = scored.mapInArrow(_returned(self.limits), _SCORED).groupBy("segment", "slot").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))  # a split file has a segment in two tasks
        none = F.lit(0).cast("long")
        return self.documents.join(slots, ["segment", "slot"], "left").select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
            F.coalesce("count_sum", none).alias("count_sum"), "groups", "groups_sha256")
