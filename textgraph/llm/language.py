"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lowered, everything but letters becomes one kind of gap, and the
n-grams of 1 to 3 characters of the whole text are hashed to a fixed number of
buckets. The table of log-probabilities (n-gram orders x buckets x languages) is
broadcast: its size is fixed by the parameters and the number of languages. A
text's score per language is the sum over its n-grams, taken in numpy for a
batch of texts at once, in pieces of bounded memory.

The fit counts n-grams where the texts are and adds up counts per language. It
reads at most about ``sample`` labelled texts, dealt by a hash of doc_id; all of
them if there are fewer.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
null labels are not learned from; with nothing to learn from all texts are
``und``; ties go to the first language in code point order; repeated rows count
as often as they stand there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 20_000
SMOOTHING = 0.5
UNDECIDED = "und"
PIECE = 1 << 18  # characters scored at once
OVERLAP = max(ORDERS) - 1


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter or 32, and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            letter[c], fold[c] = True, ord(low) if len(low) == 1 else c
    return fold, letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams starting at each character; ``points`` end in a gap."""
    h = points[: len(points) - order + 1] * np.uint32(0x9E3779B1)
    for k in range(1, order):
        h = (h ^ points[k : len(points) - order + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Languages and their log-probabilities, ``table[order][bucket, language]``."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING  # language, order, bucket
        logs = np.log(smooth) - np.log(smooth.sum(axis=2, keepdims=True))
        self.table = np.ascontiguousarray(logs.transpose(1, 2, 0)).astype(np.float32)
        self.prior = np.log((documents + 1) / (documents.sum() + len(langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        fold, letter = _tables()
        langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        sums = np.zeros((len(texts), len(self.langs)))
        judged = np.zeros(len(texts), bool)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            ends = np.cumsum([len(p) for _, p in held])
            starts = np.r_[0, ends[:-1]]
            cuts = np.stack([starts, ends - OVERLAP], axis=1).ravel()
            points = np.concatenate([p for _, p in held] + [np.full(OVERLAP, 32, np.uint32)])
            for k, order in enumerate(ORDERS):
                logs = self.table[k][_buckets(points, order)]
                # Every second sum is of n-grams that start in an overlap.
                np.add.at(sums, [n for n, _ in held], np.add.reduceat(logs, cuts, axis=0, dtype=np.float64)[::2])
            held.clear()

        for n, text in enumerate(texts):
            raw = _points(text or "")
            if not letter[raw].any():
                continue
            judged[n] = True
            points = np.concatenate([[np.uint32(32)], fold[raw], np.full(1 + OVERLAP, 32, np.uint32)])
            for at in range(0, len(points) - OVERLAP, PIECE):
                # The next piece's first characters complete this piece's n-grams.
                held.append((n, points[at : at + PIECE + OVERLAP]))
                size += len(held[-1][1])
                if size >= PIECE:
                    flush()
                    size = 0
        if held:
            flush()
        sums += self.prior
        sums -= sums.max(axis=1, keepdims=True)
        best, odds = sums.argmax(axis=1), 1.0 / np.exp(sums).sum(axis=1)
        for n in np.flatnonzero(judged).tolist():
            langs[n], scores[n] = self.langs[best[n]], float(odds[n])
        return langs, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts per task: language, order * BUCKETS + bucket, n; -1 counts texts."""
    fold, _ = _tables()
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            into = counts.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int64))
            texts[lang] = texts.get(lang, 0) + 1
            points = np.concatenate([[np.uint32(32)], fold[_points(text)], np.full(3, 32, np.uint32)])
            for k, order in enumerate(ORDERS):
                into[k] += np.bincount(_buckets(points, order), minlength=BUCKETS)
    for lang, into in counts.items():
        flat = into.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({
            "lang": [lang] * (len(at) + 1), "bucket": np.r_[-1, at], "n": np.r_[texts[lang], flat[at]],
        }, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``doc_id, text, lang``; rows without text or lang are left out.

    What is collected is the model: at most orders x buckets rows per language.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, sample / max(1, rows.select("doc_id").count()))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    found = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    model = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(model["lang"].unique())
    counts = np.zeros((len(langs), len(ORDERS) * BUCKETS))
    documents = np.zeros(len(langs))
    row = model["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(dtype=np.int64)
    bucket, n = model["bucket"].to_numpy(dtype=np.int64), model["n"].to_numpy(dtype=np.float64)
    counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    documents[row[bucket < 0]] = n[bucket < 0]
    return Model(langs, counts.reshape(len(langs), len(ORDERS), BUCKETS), documents)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """The input's columns, then ``lang_pred`` and ``score``; only ``text`` is read for them."""
    carried = documents.drop("lang_pred", "score")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = carried.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.predict(batch.column(at).to_pylist())
            out = pa.Table.from_batches([batch])
            out = out.append_column("lang_pred", pa.array(langs, pa.string()))
            yield from out.append_column("score", pa.array(scores, pa.float64())).to_batches()

    schema = carried.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return carried.mapInArrow(run, schema)


def known(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language, a null ``lang`` filled with the predicted one.

    A ``lang`` that is given stays. With no language learned, rows with a letter
    are kept as they are. The columns are those of the input.
    """
    sent, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")
    given = documents.columns.index("lang") if "lang" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _tables()[1]
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if not sent.value.langs:
                yield batch.filter(pa.array([bool(letter[_points(t or "")].any()) for t in texts], pa.bool_()))
                continue
            found = sent.value.predict(texts)[0]
            if given is not None:
                own = batch.column(given)
                filled = pa.array([f if g is None else g for f, g in zip(found, own.to_pylist())], own.type)
                batch = batch.set_column(given, batch.schema.field(given), filled)
            yield batch.filter(pa.array([lang != UNDECIDED for lang in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
