"""Packing: patterns over histograms, ids against whole texts, sequences without gaps."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from textgraph.llm import packing
from test_alignment import odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def padding(sizes, tokens):
    return sum(tokens - n for n in sizes if n & (n - 1))


def checked(histogram, tokens, least):
    """Every token of every rank stands once; returns sizes and numbers of sequences."""
    groups = packing.packed(histogram, tokens, least)
    rows, _ = packing.places(groups)
    by_bin = defaultdict(list)
    for bin_, first, last, _, start, length, _, _ in rows:
        by_bin[bin_].append((first, last + 1, start, length))
    assert set(by_bin) == set(histogram)
    for bin_, ranges in by_bin.items():
        cuts = sorted({x for r in ranges for x in r[:2]})
        assert cuts[0] == 0 and cuts[-1] == histogram[bin_]
        for rank in cuts[:-1]:
            at = 0
            for start, length in sorted((s, n) for a, b, s, n in ranges if a <= rank < b):
                assert start == at
                at += length
            assert at == bin_
    return [(sum(p.times * p.length for p in g.pieces), g.count) for g in groups]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), min_size=1, max_size=20))
def test_patterns(histogram):
    sizes = checked(histogram, 64, 4)
    assert all(0 < n <= 64 for n, _ in sizes)
    assert sum((64 - n) * c for n, c in sizes if n & (n - 1)) <= 3 * sum(c for _, c in sizes) + 64


@pytest.mark.parametrize("histogram", [{2100: 1_000_000}, {1: 10**12}, {1400: 999, 2100: 5}, {n: 10**9 // n**2 + 1 for n in range(1, 4096)}])
def test_large_histograms_leave_little_padding(histogram):
    sizes = checked(histogram, 4096, 32)
    total = sum(n * c for n, c in histogram.items())
    assert sum((4096 - n) * c for n, c in sizes if n & (n - 1)) <= 0.004 * total
    assert len(sizes) < 20_000


def packed_rows(df, tokens=packing.TOKENS, **options):
    return [r.asDict() for r in packing.pack(df, PATH, tokens=tokens, **options).collect()]


def check_pieces(rows, got, tokenizer, tokens):
    whole = sorted((d is not None, d or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in rows)
    by_doc = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by_doc[r["doc_id"]].append((r["doc_tokens"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for doc_id, pieces in by_doc.items():  # several rows may have one id
        ends = [list(ids) for known, d, ids in whole if (d if known else None) == doc_id]
        left = sorted(ids for n, s, ids in pieces)
        want = []
        starts = defaultdict(list)
        for n, s, ids in pieces:
            starts[s].append((n, ids))
        for ids in ends:
            at = 0
            while at < len(ids):
                n, part = next((n, p) for n, p in starts[at] if n == len(ids) and list(p) == ids[at : at + len(p)])
                starts[at].remove((n, part))
                want.append(part)
                at += len(part)
            assert at == len(ids)
        assert sorted(want) == left
    assert len(by_doc) == len({d for d, _ in rows})
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(sequences) == set(range(len(sequences)))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= tokens
    return sizes


@pytest.mark.parametrize("tokens", [16, 64, 4096])
def test_odd_texts(spark, tokenizer, tokens):
    rows = odd_texts() + [(1000, "word " * 5000), (1001, "x" * 3000), (1002, "one <|endoftext|>two <|startoftext|>")] * 2
    rows += [(2000 + n, "same length of all these") for n in range(200)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, start int, part int, bin string").repartition(3)
    sizes = check_pieces(rows, packed_rows(df, tokens, least=4), tokenizer, tokens)
    assert padding(sizes, tokens) <= 3 * len(sizes) + tokens


def test_given_documents(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    sizes = check_pieces(rows, packed_rows(df.repartition(4)), tokenizer, 4096)
    assert padding(sizes, 4096) < 0.01 * sum(sizes)
    again = packing.pack(df, PATH).selectExpr("crc32(ids) c", "ids").first()
    assert again["c"] == zlib.crc32(again["ids"])


def test_offsets_that_are_shuffled(spark, tokenizer, monkeypatch):
    plain = packing.lookup_join
    monkeypatch.setattr(packing, "lookup_join", lambda *a: plain(*a, limit=0))
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_pieces(rows, packed_rows(df, 64), tokenizer, 64)


def test_empty_table(spark):
    assert packed_rows(spark.createDataFrame([], "doc_id long, text string")) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB'sZ1.,-<|>endoftx(\n\t\r éε中Σİ́\x1c\x85\U0001f600 "), max_size=40))
def test_words_give_the_ids_of_the_text(tokenizer, text):
    words = packing.Words(PATH)
    assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_at_white_space(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 20)
    monkeypatch.setattr(packing, "WORDS", 5)
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "é", " ", "\n", "Cd", "'s", "  ", "\r\n", "　", "x" * 30]) for _ in range(500))
    assert np.frombuffer(packing.Words(PATH).ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAZéÉßÿØ÷×ªµİe\u0301.,;!'-1<|>"), max_size=12), max_size=8))
def test_plain_words_by_the_model_alone(tokenizer, words):
    made = packing.Words(PATH)
    assert made.plain
    text = " ".join(words)
    assert np.frombuffer(made.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    others = made._learn_plain(words)
    assert others == [w for w in words if not packing.PLAIN.fullmatch(w)]


def test_a_stem_is_asked_for_once():
    made, asked = packing.Words(PATH), []
    model, raw, letters = made.plain

    class Noted:
        def tokenize(self, part):
            asked.append(part)
            return model.tokenize(part)

    made.plain = Noted(), raw, letters
    made.ids("Straße straße, STRAßE. straße! une une, Une.")
    assert sorted(asked) == ["!", ",", ".", "stra" + "Ã" + "Ł" + "e", "une"]


def test_other_steps_before_the_model_take_the_whole_tokenizer(tmp_path):
    import json

    given = json.load(open(PATH, encoding="utf-8"))
    given["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given), encoding="utf-8")
    assert packing._plain(str(path)) is None


def test_words_stay_from_task_to_task():
    assert packing._words(PATH) is packing._words(PATH)
