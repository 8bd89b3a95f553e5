"""Cross-tokenizer alignment against whole texts, aligned byte by byte."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import brute
from textgraph.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def tokens(tokenizers, text):
    """[(id, first byte, end)] of both, or None; the bytes of A's tokens come from its decoder's alphabet."""
    a, b = tokenizers
    letters = alignment._byte_of_letter()
    raw = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
        return None

    def placed(ids, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return [(i, e - len(p), e) for i, p, e in zip(ids, parts, ends)]

    return placed(ids_a, parts_a), placed(ids_b, parts_b)


def plain(tokenizers, rows):
    linked, out = [], []
    for _, text in rows:
        got = tokens(tokenizers, text or "")
        links, groups = [], []
        if got:
            a, b = got
            first = 0
            for i, x, y in a:
                while b[first][2] <= x:
                    first += 1
                links += [(i, j) for j, s, e in b[first : first + y - x + 1] if s < y and x < e]
            cuts = sorted({t[2] for t in a} & {t[2] for t in b})
            p = q = 0
            for cut in cuts:
                mine, other = [], []
                while p < len(a) and a[p][2] <= cut:
                    mine.append(a[p][0])
                    p += 1
                while q < len(b) and b[q][2] <= cut:
                    other.append(b[q][0])
                    q += 1
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, other)))
        linked.append((got, links, groups))
    counts, most = Counter(p for _, links, _ in linked for p in set(links)), {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    for (doc_id, _), (got, links, groups) in zip(rows, linked):
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((
            doc_id, len(got[0]) if got else 0, len(got[1]) if got else 0, len(groups), len(links), best, sum(counts[p] for p in links),
            brute.sha(";".join(groups)) if got else ""))
    return sorted(out, key=repr)


def scored(df, limits=alignment.LIMITS):
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.Alignment(df, *PATHS, limits=limits).scores().collect()), key=repr)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "it's we'll I'D can't 've", "x\n y\n\nz", "tab\tx \t y", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "▁x", "café café   x", "中文 字典 word", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "1234567 3.14 12 34", "((a)) => {b}; //c",
    "a　b   c", "x\x1cy z\x1c w", "İ ẞ ﬁ", "\r\n a\r b", "aaaa" * 200, "the the the the", "\x00 a \x00",
]


def odd_texts():
    rng = random.Random(7)
    words = ["the", "The", "don't", "naive", "naïve", "x1", "42", "foo_bar", "--", "(see", "end).", "中", "a\nb", "\t", "", "Z" * 30]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = [(n, t) for n, t in enumerate(texts)]
    return rows + [(None, "the end"), (5, "the end"), (5, "the end"), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, tokenizers, small):
    # many segments, postings in parts, bitmaps beyond two slots, long texts in slices, counts that are shuffled
    limits = alignment.Limits(slice=50, slots=16, array=2, held=40, segment=300, units=20, broadcast=10) if small else alignment.LIMITS
    rows = odd_texts()
    if small:
        rows.append((900, "the " * 300 + "▁ late"))  # found unreadable in its last slice
        rows.append((901, "the end don't " * 200))
    schema = "doc_id long, text string, pair string, slot string, kind string"
    df = spark.createDataFrame([(*r, "p", "s", "k") for r in rows], schema).repartition(3)
    assert scored(df, limits) == plain(tokenizers, rows)


def test_given_documents(spark, tokenizers):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert scored(df) == plain(tokenizers, [tuple(r) for r in df.collect()])


def test_empty_table_and_groups(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert scored(df.limit(0)) == []
    found = alignment.Alignment(df, *PATHS, keep_groups=True)
    row = found.scores().first()
    assert row["groups_sha256"] == brute.sha(row["groups"]) and row["groups"].count("|") == row["n_groups"] == 2
    assert {(r["documents"], r["links"], r["best"]) for r in found.pairs().collect()} == {(1, 1, True)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZ1.,-(\n\t é中  \x1c\U0001f600"), max_size=6), max_size=8).map(" ".join))
def test_units_give_the_tokens_of_the_text(tokenizers, text):
    units = alignment.Units(*PATHS)
    numbers = units.numbers(text)
    whole = tokens(tokenizers, text)
    if text and all(units.good[n] for n in numbers):
        assert sum(units.n_a[n] for n in numbers) == len(whole[0]) and sum(units.n_b[n] for n in numbers) == len(whole[1])
    else:
        assert whole is None or not text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 65535), st.integers(1, 70), min_size=1, max_size=60), st.sampled_from([4096, 3]))
def test_postings_round_trip(held, array):
    limits = alignment.Limits(array=array)
    slots = np.array(sorted(held))
    times = np.array([held[s] for s in slots.tolist()])
    (n,), (docs,), (planes,) = alignment.encoded(np.zeros(1, np.int64), slots, times, limits)
    back, again = alignment.decoded(int(n), docs, planes, limits)
    assert back.tolist() == slots.tolist() and again.tolist() == times.tolist()
    assert alignment.links_of(int(n), planes) == times.sum()
