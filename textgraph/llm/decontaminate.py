"""Benchmark decontamination by CGK embedding and bit sampling.

Texts and benchmark items are sequences of words: runs of letters, digits and
marks of any script, and single characters of scripts without spaces. The CGK walk embeds a sequence
of n symbols in 3n: at each step it writes the current symbol and moves on if a
random bit of step and symbol says so, so walks over two sequences fall into step
again after an edit and few places differ. Keys are samples of ``SAMPLED``
places. A window of an item's size and the item meet if a key agrees; walks and
samples are repeated until two sequences that differ in ``FAR`` of the embedded
places meet with ``RECALL``. What meets is verified: the exact edit distance of
the item to the best part of the text there must be within ``RATE`` of its words.

Windows are laid where a run of up to ``SEED`` words of the item stands in the
text. No passage within the distance is without one: d edits leave a run of
(n - d) / (d + 1) words whole, which is 3 or more at this rate, or the item.

The items travel to the tasks in blocks of bounded size; more items mean more
passes, never a larger block. Nothing of the documents is shuffled.

Defined results: null and empty texts match nothing; an item without words is
matched by nothing; every (row, item) within the distance is reported once, with
its best place (then the first); repeated rows are judged one by one; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgraph.llm import licences

RATE = 0.15  # edits per word of an item
SEED = 3
SAMPLED = 3  # places per key
FAR, RECALL = 0.4, 0.99
KEYS = ceil(log(1 - RECALL) / log(1 - (1 - FAR) ** SAMPLED))
WALKS = 5  # keys are spread over so many walks
BLOCK_BYTES = 16 << 20  # of item texts per pass
WINDOWS, WINDOW_WORDS = 1 << 15, 1 << 21  # embedded at once, at most
WORDS_AT_ONCE = 1 << 19


# Scripts that are written without spaces between words.
_UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007),
    (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]


_WORD, _MARK, _BETWEEN, _SINGLE = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Per code point what it is to words; ASCII is left to ``licences.words``."""
    kinds = np.full(0x110000, _BETWEEN, np.uint8)
    kinds[:0x80] = _WORD
    for c in range(0x80, 0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kinds[c] = _WORD
        elif major == "M":
            kinds[c] = _MARK
    for a, b in _UNSPACED:
        kinds[a : b + 1][kinds[a : b + 1] == _WORD] = _SINGLE
    return kinds


def words(text: str | None) -> list[bytes]:
    """A-Z is lowered; other letters stay as they are. Marks go with the character before them."""
    if text and not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[points]
        if (kinds >= _BETWEEN).any():
            points = np.where(kinds == _BETWEEN, np.uint32(32), points)
            own = np.flatnonzero(kinds != _MARK)
            single = kinds[own] == _SINGLE
            text = np.insert(points, own[single | np.r_[False, single[:-1]]], 32).tobytes().decode("utf-32-le", "surrogatepass")
    return licences.words(text)


def allowed(n: int) -> int:
    """Edits allowed for an item of n words."""
    return int(RATE * n)


def at_once(n: int) -> int:
    """Windows of n words that are embedded or compared at once."""
    return max(1, min(WINDOWS, WINDOW_WORDS // n))


class Finder:
    """The embedded items and their keys."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 8):
        self.items = [(i, w) for i, t in items if (w := words(t))]
        self.vocabulary: dict[bytes, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in self.items]
        self.coded, self.longest = coded, max((len(c) for c in coded), default=0)
        random = np.random.default_rng(seed)
        steps = 3 * self.longest
        # The walk's bit of step and word is hashed from one number for each.
        self.steps = random.integers(0, 2**64, (WALKS, steps), dtype=np.uint64)
        self.marks = random.integers(0, 2**64, len(self.vocabulary) + 1, dtype=np.uint64)
        self.weights = random.integers(1, 2**62, SAMPLED, dtype=np.int64) | 1
        self.samples = random.random((KEYS, SAMPLED))  # as shares of an embedding's length
        # Items by their seeds, and by size and key.
        self.pad = self.longest + 2 * allowed(self.longest) + 2
        seeds, owners, offsets = [], [], []
        for n, c in enumerate(coded):
            run = min(SEED, len(c))
            for at in range(len(c) - run + 1):
                seeds.append(self._seed([c[at + k] if k < run else 0 for k in range(SEED)]))
                owners.append(n)
                offsets.append(at)
        order = np.argsort(np.array(seeds, np.int64), kind="stable")
        self.seeds = np.array(seeds, np.int64)[order]
        self.owners, self.offsets = np.array(owners, np.int64)[order], np.array(offsets, np.int64)[order]
        self.runs = sorted({min(SEED, len(c)) for c in coded})
        self.by_size: dict[int, np.ndarray] = {}
        for n, c in enumerate(coded):
            self.by_size[len(c)] = np.append(self.by_size.get(len(c), np.zeros(0, np.int64)), n)
        self.keys = {
            size: self.embed(np.stack([coded[n] for n in held])) for size, held in self.by_size.items()
        }  # items of the size x KEYS

    def _seed(self, codes):
        base = len(self.vocabulary) + 1
        total = 0
        for c in codes:
            total = total * base + c
        return total

    def _moves(self, walk: int, step: int, symbol: np.ndarray) -> np.ndarray:
        h = (self.marks[symbol] ^ self.steps[walk, step]) * np.uint64(0xBF58476D1CE4E5B9)
        return (((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)).astype(np.int64)

    def embed(self, windows: np.ndarray) -> np.ndarray:
        """Keys of windows (rows of word codes): windows x KEYS."""
        count, size = windows.shape
        padded = np.concatenate([windows, np.zeros((count, 1), np.int64)], axis=1)
        length, rows = 3 * size, np.arange(count)
        keys = np.zeros((count, KEYS), np.int64)
        for walk in range(WALKS):
            at = np.zeros(count, np.int64)
            own = range(walk, KEYS, WALKS)
            wanted: dict[int, list[tuple[int, int]]] = {}
            for key in own:
                for place, share in enumerate(self.samples[key]):
                    wanted.setdefault(int(share * length), []).append((key, place))
            for step in range(max(wanted) + 1):
                symbol = padded[rows, at]
                for key, place in wanted.get(step, ()):
                    keys[:, key] += (symbol + 1) * self.weights[place]
                at = np.minimum(at + self._moves(walk, step, symbol), size)
        return keys

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, first word, words) for every text and item within the distance."""
        if not self.items:
            return []
        found, held, size = [], [], 0
        get = self.vocabulary.get
        for n, text in enumerate(texts):
            ws = words(text)
            codes = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
            held.append((n, codes))
            size += len(codes) + self.pad
            if size >= WORDS_AT_ONCE:
                found += self._find(held)
                held, size = [], 0
        return found + (self._find(held) if held else [])

    def _find(self, held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        gap = np.zeros(self.pad, np.int64)
        parts, begins, at = [gap], [], self.pad
        for _, codes in held:
            parts += [codes, gap]
            begins.append(at)
            at += len(codes) + self.pad
        begins, codes = np.array(begins), np.concatenate(parts)
        places, entries = [], []
        for run in self.runs:
            stop = len(codes) - SEED
            whole = np.flatnonzero(np.logical_and.reduce([codes[k : stop + k] > 0 for k in range(run)]))
            seeds = self._seed([codes[whole + k] if k < run else np.zeros(len(whole), np.int64) for k in range(SEED)])
            low, high = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
            hits = high - low
            places.append(np.repeat(whole, hits))
            entries.append(np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits))
        place, entry = np.concatenate(places), np.concatenate(entries)
        if not len(place):
            return []
        sizes = np.array([len(c) for c in self.coded])
        size = sizes[self.owners[entry]]
        start = place - self.offsets[entry]
        doc = np.searchsorted(begins, place, "right") - 1
        # A window that an insertion or deletion shifts over an end is laid at the end.
        ends = begins + np.array([len(c) for _, c in held])
        start = np.maximum(np.minimum(start, ends[doc] - size), begins[doc])
        # Within the distance, all words but the edited ones are words of an item.
        known = np.r_[0, np.cumsum(codes > 0)]
        spare = np.array([allowed(n) for n in range(self.longest + 1)])[size]
        low, high = np.maximum(start - spare, begins[doc]), np.minimum(start + size + spare, ends[doc])
        good = known[high] - known[low] >= size - spare
        if not good.any():
            return []
        windows = np.unique(np.stack([size, start, doc])[:, good], axis=1)
        met: list[np.ndarray] = []  # item, start, doc
        for n in np.unique(windows[0]).tolist():
            of_size = windows[1:, windows[0] == n]
            for at in range(0, of_size.shape[1], at_once(n)):
                start, doc = of_size[:, at : at + at_once(n)]
                met.append(self._meet(n, codes, start, doc))
        met_all = np.concatenate(met, axis=1)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in np.unique(sizes[met_all[0]]).tolist():
            item, start, doc = met_all[:, sizes[met_all[0]] == n]
            for at in range(0, len(item), at_once(n)):
                part = slice(at, at + at_once(n))
                edits, first, stop = self._distances(n, codes, item[part], start[part], begins[doc[part]], ends[doc[part]])
                for k in np.flatnonzero(edits <= allowed(n)).tolist():
                    key = (int(doc[part][k]), int(item[part][k]))
                    got = (int(edits[k]), int(first[k] - begins[key[0]]), int(stop[k] - first[k]))
                    out[key] = min(out.get(key, got), got)
        return [(held[d][0], self.items[i][0], *got) for (d, i), got in sorted(out.items())]

    def _meet(self, n: int, codes: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Windows and items of n words that agree in a key."""
        keys, items = self.embed(codes[start[:, None] + np.arange(n)]), self.keys[n]
        pairs = []
        for k in range(KEYS):
            order = np.argsort(items[:, k], kind="stable")
            sorted_ = items[order, k]
            low, high = np.searchsorted(sorted_, keys[:, k], "left"), np.searchsorted(sorted_, keys[:, k], "right")
            hits = high - low
            window = np.repeat(np.arange(len(start)), hits)
            item = order[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
            pairs.append(item * len(start) + window)
        pair = np.unique(np.concatenate(pairs))
        item, window = np.divmod(pair, len(start))
        return np.stack([self.by_size[n][item], start[window], doc[window]])

    def _distances(self, n, codes, item, start, begin, end):
        """Edit distance of each item to the best part of the text around its window; where that part begins and ends."""
        d = allowed(n)
        low, high = np.maximum(start - d, begin), np.minimum(start + n + d, end)
        width = n + 2 * d
        columns = np.arange(width)
        text = np.where(low[:, None] + columns < high[:, None], codes[np.minimum(low[:, None] + columns, len(codes) - 1)], -1)
        pattern = np.stack([self.coded[i] for i in item.tolist()])
        far, scale = 4 * width, 1 << 20  # a cell holds cost * scale + the column where its part begins
        row = np.tile(np.arange(width + 1), (len(item), 1))
        costs = np.arange(width + 1)
        for k in range(n):
            differs = text != pattern[:, k : k + 1]
            new = row + scale
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + differs * scale)
            # along the row: the least of all cells before, one edit per column passed
            row = np.minimum.accumulate(new - costs * scale, axis=1) + costs * scale
        inside = np.arange(width + 1) <= (high - low)[:, None]
        row = np.where(inside, row, far * scale)
        best = row.min(axis=1)
        stop = row.argmin(axis=1)
        return best // scale, low + best % scale, low + stop


RESULT = "doc_id long, item_id long, edits int, first_word long, n_words long"
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()),
])


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"].encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _find_in(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = finder.find(batch.column(1).to_pylist())
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_pydict(
                dict(zip(_FOUND.names, ([ids[n] for n in columns[0]], *map(list, columns[1:])))), _FOUND)

    return run


def passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, first_word, n_words`` of the benchmark passages in texts."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.sparkSession.createDataFrame([], RESULT)
    for items in _item_blocks(benchmark):
        found = found.unionByName(texts.mapInArrow(_find_in(items), RESULT))
    return found


def _without(items: list[tuple[int, str]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for batch in batches:
            held = {row[0] for row in finder.find(batch.column(at).to_pylist())}
            yield batch.filter(pa.array([n not in held for n in range(len(batch))], pa.bool_()))

    return run


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no benchmark passage."""
    kept = documents
    for items in _item_blocks(benchmark):
        kept = kept.mapInArrow(_without(items, kept.columns.index("text")), kept.schema)
    return kept
