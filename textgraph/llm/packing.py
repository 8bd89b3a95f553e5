"""Packing token sequences: shortest-pack-first over the histogram of lengths.

A document's ids, an end id behind them, are cut into full pieces of the sequence
length, which are sequences of their own, and a remainder. Remainders are packed by
their histogram (fewer bins than the sequence length) and not one by one:

1. Lengths are placed longest first, all documents of a length at once, each into
   the packs with the most room; the counts of packing patterns are split as needed.
2. What padding is left is filled: the emptiest packs, as many as the free room of
   all can take, are dissolved, and their pieces placed again, longest first. A
   piece that fits nowhere is cut, if the room is ``LEAST`` tokens or more.
3. What room of ``LEAST`` or more is left then is less than about one sequence over all
   packs. A pack with an eighth of the sequence free is cut into sequences of powers
   of two, which are not padded.

So a sequence has less than ``LEAST`` tokens of padding, but for a few. Patterns go back to
documents by rank: a task counts the documents of each length as it writes them, an
offset per task and length makes that a rank over all, and each piece of a pattern
takes a range of ranks. The driver holds the histogram and the patterns, some ten
thousand rows at most whatever the number of documents. Offsets are broadcast up to
a measured size.

Defined results: a null or empty text is its end id alone. Rows repeated with one id
are documents of their own; a null id stays. Texts are read in slices. An empty table
gives no rows. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgraph.functions.joins import lookup_join
from textgraph.session import run_folder, stage

TOKENS, END, LEAST = 4096, 2, 32
WIDTH = 4  # bytes of an id
SPACE = re.compile("[ \t\n\r]")
MARK = "\0"
MARKED = f" {MARK} "
SLICE = 1 << 20  # characters of a text read at once
# A word of Latin letters without combining marks, with punctuation behind it or none. With these steps before its
# model a tokenizer makes two parts of it, the letters in lower case, as UTF-8 in signs for bytes, and the punctuation.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None,
}
WORDS, WORD_BYTES = 1 << 19, 1 << 26  # words a worker remembers, and their ids
BATCH = 1 << 24  # bytes of ids written at once

_ROW = "part long, doc_id long, tokens long, bin int, place long, full long, full_place long, ids binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ROWS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _ROW.split(", ")])


@dataclass
class Piece:
    """Pieces of the documents with ranks from ``rank`` among those of one remainder, ``times`` in each pack of a group."""

    bin: int
    rank: int
    times: int
    start: int
    length: int


@dataclass
class Group:
    """``count`` packs of one pattern."""

    count: int
    room: int
    pieces: list[Piece]

    def first(self, count: int) -> Group:
        """So many packs of the pattern, as a group of its own."""
        return Group(count, self.room, [Piece(p.bin, p.rank, p.times, p.start, p.length) for p in self.pieces])

    def split(self, count: int) -> Group:
        """Take so many packs off; the others keep the ranks behind theirs."""
        own = self.first(count)
        self.count -= count
        for p in self.pieces:
            p.rank += count * p.times
        return own


class Packs:
    """Groups by the room that is left in their packs."""

    def __init__(self, tokens: int) -> None:
        self.tokens, self.by_room, self.rooms = tokens, defaultdict(list), []

    def add(self, group: Group) -> None:
        if not self.by_room[group.room]:
            heapq.heappush(self.rooms, -group.room)
        self.by_room[group.room].append(group)

    def most_room(self) -> int:
        while self.rooms and not self.by_room[-self.rooms[0]]:
            heapq.heappop(self.rooms)
        return -self.rooms[0] if self.rooms else 0

    def shortest(self, count: int) -> Group:
        """At most so many packs of a pattern with the most room."""
        held = self.by_room[self.most_room()]
        return held[-1].split(count) if held[-1].count > count else held.pop()

    def groups(self) -> list[Group]:
        return [g for room in sorted(self.by_room) for g in self.by_room[room]]

    def place(self, piece: Piece, count: int, least: int | None = None) -> list[tuple[Piece, int]]:
        """Put ``count`` pieces into the shortest packs, then into new ones; with ``least`` cut them to the room before.

        Returns the ends that were cut off and how many there are.
        """
        left, rank = [], piece.rank
        while count:
            room = self.most_room()
            if room >= piece.length:
                group = self.shortest(count)
                # So many at once as bring the pack down to the next shortest.
                times = min((room - max(self.most_room(), room - group.room)) // piece.length + 1, room // piece.length, count)
                packs = min(group.count, count // times)
                if packs < group.count:
                    own = group.split(packs)
                    self.add(group)
                    group = own
                taken, used = packs * times, times * piece.length
                group.pieces.append(Piece(piece.bin, rank, times, piece.start, piece.length))
            elif least is not None and room >= least:
                group = self.shortest(count)
                taken, used = group.count, room
                group.pieces.append(Piece(piece.bin, rank, 1, piece.start, room))
                left.append((Piece(piece.bin, rank, 1, piece.start + room, piece.length - room), taken))
            else:
                times = min(self.tokens // piece.length, count)
                packs = count // times
                group = Group(packs, self.tokens, [Piece(piece.bin, rank, times, piece.start, piece.length)])
                taken, used = packs * times, times * piece.length
            group.room -= used
            self.add(group)
            count, rank = count - taken, rank + taken
        return left


def packed(histogram: dict[int, int], tokens: int = TOKENS, least: int = LEAST) -> list[Group]:
    """Groups of packs that hold every rank of every length once."""
    packs = Packs(tokens)
    for length in sorted(histogram, reverse=True):
        packs.place(Piece(length, 0, 1, 0, length), histogram[length])
    sequences = sum(g.count for g in packs.groups())
    while True:
        filled = _filled(packs, tokens, least)
        fewer = sum(g.count for g in filled.groups())
        if fewer >= sequences:
            break
        packs, sequences = filled, fewer
    out = []
    for group in packs.groups():
        out += _powers(group, tokens) if group.room >= max(least, tokens // 8) else [group]
    return out


def _filled(packs: Packs, tokens: int, least: int) -> Packs:
    """The emptiest packs dissolved into the room of the others."""
    spare = sum(g.room * g.count for g in packs.groups() if g.room >= least) // tokens
    after, loose = Packs(tokens), []
    for group in sorted(packs.groups(), key=lambda g: -g.room):
        group = group.first(group.count)
        if spare and group.room >= least:
            gone = group.split(min(spare, group.count))
            spare -= gone.count
            loose += [(p, gone.count * p.times) for p in gone.pieces]
        if group.count:
            after.add(group)
    heap = [(-p.length, n, p, count) for n, (p, count) in enumerate(loose)]
    heapq.heapify(heap)
    made = len(heap)
    while heap:
        _, _, piece, count = heapq.heappop(heap)
        for end, taken in after.place(piece, count, least):
            heapq.heappush(heap, (-end.length, made, end, taken))
            made += 1
    return after


def _powers(group: Group, tokens: int) -> list[Group]:
    """Each pack cut into sequences of powers of two."""
    used, out = tokens - group.room, []
    sizes = [1 << k for k in reversed(range(used.bit_length())) if used >> k & 1]
    for pack in (group.split(1) for _ in range(group.count)):
        pieces = [Piece(p.bin, p.rank + n, 1, p.start, p.length) for p in pack.pieces for n in range(p.times)]
        for size in sizes:
            own, room = [], size
            while room:
                p = pieces.pop(0)
                if p.length > room:
                    pieces.insert(0, Piece(p.bin, p.rank, 1, p.start + room, p.length - room))
                    p = Piece(p.bin, p.rank, 1, p.start, room)
                own.append(p)
                room -= p.length
            out.append(Group(1, 0, own))
    return out


def places(groups: Iterable[Group]) -> tuple[list[tuple], int]:
    """Where ranks go: ``(bin, first rank, last rank, times, start, length, sequence of the first, offset)``, and the number of sequences."""
    out, sequence = [], 0
    for group in groups:
        offset = 0
        for p in group.pieces:
            out.append((p.bin, p.rank, p.rank + group.count * p.times - 1, p.times, p.start, p.length, sequence, offset))
            offset += p.times * p.length
        sequence += group.count
    return out, sequence


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, f"<u{WIDTH}").tobytes()


@lru_cache(maxsize=1)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _plain(path: str):
    """The model, the bytes of each id and the signs of each letter, for words of ``PLAIN``; None if other steps come before the model."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    if any(given.get(name) != step for name, step in STEPS.items()) or given["model"].get("type") != "BPE":
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that are their own sign
    signs = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    letters = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
    tokenizer = _loaded(path)
    return tokenizer.model, [_bytes([i]) for i in range(tokenizer.get_vocab_size())], letters


class Words:
    """Ids of words between white space, as bytes; no token holds white space, so a text's ids are those of its words."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known, self.size = _loaded(path), {"": b""}, 0
        self.plain = _plain(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = SPACE.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            out.append(self._piece(text[at:end]))
            at = end
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.known) > WORDS or self.size > WORD_BYTES:
            self.known, self.size = {"": b""}, 0
        new = list(set(words).difference(self.known))
        if new and self.plain:
            new = self._learn_plain(new)
        if new:
            self._learn([w for w in new if MARK not in w])
            for word in new:
                if word not in self.known:
                    self._keep(word, _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids))
        return b"".join(map(self.known.__getitem__, words))

    def _learn_plain(self, words: list[str]) -> list[str]:
        """Words of ``PLAIN`` by the model alone, each stem in lower case once; returns the others."""
        known, others, match, size = self.known, [], PLAIN.fullmatch, 0
        for word in words:
            found = match(word)
            if found is None:
                others.append(word)
                continue
            stem, mark = found.groups()
            stem = stem.lower()
            ids = known.get(stem)
            if ids is None:
                ids = self._part(stem)
            if mark:
                held = known.get(mark)
                ids += self._part(mark) if held is None else held
            if word != stem:
                known[word] = ids
                size += len(ids) + len(word)
        self.size += size
        return others

    def _part(self, part: str) -> bytes:
        model, raw, letters = self.plain
        ids = b"".join([raw[t.id] for t in model.tokenize(part if part.isascii() else part.translate(letters))])
        self._keep(part, ids)
        return ids

    def _learn(self, words: list[str]) -> None:
        """Many words as one text, with a mark between them that is one token."""
        ids = np.array(self.tokenizer.encode_batch_fast([MARKED.join(words)], add_special_tokens=False)[0].ids, f"<u{WIDTH}")
        ends = np.flatnonzero(ids == self.mark).tolist()
        if len(ends) == len(words) - 1:  # else they are encoded one by one
            raw = ids.tobytes()
            for word, a, b in zip(words, [-1, *ends], [*ends, len(ids)]):
                self._keep(word, raw[WIDTH * (a + 1) : WIDTH * b])

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.size += len(ids) + len(word)


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """The words a Python worker remembers, from one of its tasks to the next."""
    return Words(path)


def _tokens(path: str, tokens: int, end: int):
    """Ids of each document, its full pieces and remainder, and how many of the same the task met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, last = _words(path), TaskContext.get().partitionId(), end.to_bytes(WIDTH, "little")
        met, full_met, rows, size = defaultdict(int), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = words.ids(text.as_py() or "") + last
                n = len(ids) // WIDTH
                full, rest = divmod(n, tokens)
                rows.append((part, doc_id.as_py(), n, rest, met[rest], full, full_met, ids))
                met[rest] += 1
                full_met += full
                size += len(ids)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    return run


def pack(documents: DataFrame, path: str, tokens: int = TOKENS, end: int = END, least: int = LEAST) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids`` (unsigned, little-endian), ``doc_tokens, sequence_id, offset``."""
    spark = documents.sparkSession
    folder = run_folder(spark, "packing")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = stage(texts.mapInArrow(_tokens(path, tokens, end), _ROW), f"{folder}/documents")

    # How many documents of a length, and full pieces (as bin 0), the tasks before had.
    per = docs.filter("bin > 0").groupBy("part", "bin").agg(F.count("*").alias("n"))
    full = docs.groupBy("part").agg(F.sum("full").alias("n")).filter("n > 0").select("part", F.lit(0).alias("bin"), "n")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task at most
    offsets = stage(
        per.unionByName(full).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), f"{folder}/offsets")
    histogram = {r["bin"]: r["n"] for r in offsets.filter("bin > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, sequences = places(packed(histogram, tokens, least))
    where = spark.createDataFrame(rows, "bin int, first long, last long, times long, from long, length long, sequence long, at long")

    ids = F.col("ids")
    cut = lambda start, length: F.substring(ids, (start * WIDTH + 1).cast("int"), (length * WIDTH).cast("int"))
    rests = lookup_join(docs.filter("bin > 0"), offsets.select("part", "bin", "before"), ["part", "bin"], "inner")
    rests = rests.withColumn("rank", F.col("before") + F.col("place"))
    rests = rests.join(F.broadcast(where), (rests["bin"] == where["bin"]) & F.col("rank").between(F.col("first"), F.col("last")))
    nth = F.col("rank") - F.col("first")
    start = F.col("full") * tokens + F.col("from")
    rests = rests.select(
        "doc_id", start.alias("start"), "length", cut(start, F.col("length")).alias("ids"), F.col("tokens").alias("doc_tokens"),
        (F.col("sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("length")).alias("offset"))

    wholes = docs.filter("full > 0").withColumn("bin", F.lit(0))
    wholes = lookup_join(wholes, offsets.filter("bin = 0").select("part", "bin", "before"), ["part", "bin"], "inner")
    piece = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("full") - 1),
        lambda n: F.struct(
            (n * tokens).alias("start"), F.lit(tokens).cast("long").alias("length"), cut(n * tokens, F.lit(tokens)).alias("ids"),
            (F.lit(sequences) + F.col("before") + F.col("full_place") + n).alias("sequence_id")))
    wholes = wholes.select("doc_id", F.col("tokens").alias("doc_tokens"), F.explode(piece).alias("p"))
    wholes = wholes.select(
        "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", F.lit(0).cast("long").alias("offset"))
    return rests.unionByName(wholes)
