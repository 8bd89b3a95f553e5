"""Operators on documents against plain versions, on odd texts and a given table."""

import hashlib
import random
import re
import time
import zlib

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textgraph.llm import decontaminate, language, licences, minhash, mixing, pii, queries, secret_scan, spans, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def near(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def test_near_duplicates(spark, given, odd, distinct):
    for rows, got in ((given, queries.op1_minhash(spark, SF)), (pairs(distinct), minhash.near_duplicates(distinct))):
        want = {d: (n, c, c == d) for d, (n, c) in brute.near_duplicates(rows).items()}
        assert near(got.collect()) == want
    every = minhash.near_duplicates(odd).collect()
    assert len(every) == odd.count()
    assert {(r["component_id"], r["kept"]) for r in every if r["doc_id"] is None} == {(None, True)}


def test_lower_thresholds_link_more(distinct):
    want = {d: c for d, (_, c) in brute.near_duplicates(pairs(distinct), 60).items()}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(distinct, 60).collect()} == want


def test_a_group_without_a_centre(spark):
    """Links that only neighbours have, and a bucket larger than one task takes."""
    base = [f"w{n}" for n in range(200)]
    chain = [(n, " ".join(base[n : n + 150])) for n in range(0, 40, 4)]
    star = [(100 + n, " ".join([*base[:75], f"x{n}", *base[76:]])) for n in range(700)]
    got = near(minhash.near_duplicates(spark.createDataFrame(chain + star, "doc_id long, text string")).collect())
    want = brute.near_duplicates(chain + star[:50])
    assert {d: got[d][1] for d in want} == {d: c for d, (_, c) in want.items()}
    assert {got[100 + n][1] for n in range(700)} == {got[100][1]}


def test_one_row_of_each_group_stays(odd, empty):
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 3, 4, 5, 6, 10, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22] and ids.count(None) == 2
    assert minhash.deduplicated(empty).collect() == [] and minhash.near_duplicates(empty).collect() == []


def removed(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def test_repeated_strings(spark, given, odd, distinct, empty):
    assert removed(queries.op2_suffix_dedup(spark, SF).collect()) == brute.without_repeats(given)
    assert removed(suffix_dedup.remove_repeats(distinct).collect()) == brute.without_repeats(pairs(distinct))
    rows = suffix_dedup.remove_repeats(odd, with_texts=True).collect()
    assert len(rows) == odd.count() and all(brute.hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)
    assert {r["n_removed"] for r in rows if r["doc_id"] is None} == {0}
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_a_line_in_very_many_texts(spark, monkeypatch):
    """One line with other text beside it in each: its pieces are dealt out and sorted in parts."""
    rng, line = random.Random(7), "A line that very many of the documents have in common."
    beside = lambda: "".join(rng.choice("abcdefghij ") for _ in range(60))
    ends = [beside() for _ in range(400)]
    rows = [(n, f"{beside()}{rng.choice(ends)}{line}{rng.choice(ends)}{beside()}") for n in rng.sample(range(10**6), 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(suffix_dedup.remove_repeats(df).collect()) == brute.without_repeats(rows)

    into, calls, whole = 8, [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda data, *rest: calls.append(len(data)) or whole(data, *rest))
    dealt = {}
    for shard, pieces in suffix_dedup._dealt(*suffix_dedup._prepared(df), into).collect():
        dealt.setdefault(shard, []).append(pieces)
    sizes = [sum(len(suffix_dedup._unpacked(b, "u1", "i8")[1]) for b in dealt.get(s, [])) for s in range(into)]
    assert max(sizes) < 2 * sum(sizes) / into
    for shard, pieces in dealt.items():
        table = pa.Table.from_pydict({"shard": [shard] * len(pieces), "pieces": [bytes(p) for p in pieces]}, suffix_dedup._PIECES)
        suffix_dedup._spans_of(into)((pa.scalar(shard),), table)
    assert calls and max(calls) <= 2 * suffix_dedup.SORTED_AT_ONCE


def test_passages_in_scripts_without_spaces(spark):
    items = [(1, "北京是中华人民共和国的首都"), (2, "日本の首都は東京であり人口は多い"), (3, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"), (4, "der erste Satz der Prüfung steht hier")]
    texts = [
        (1, "我们都知道，北京是中华人民共和国的首都。这里还有别的内容"), (2, "ご存じの通り、日本の首都は東京であり人口は多い。そうです"),
        (3, "เราทราบว่ากรุงเทพมหานครเป็นเมืองหลวงของประเทศไทยและใหญ่มาก"), (4, "vorher\u2014der erste\u00a0Satz der Prüfung steht hier\u2026danach"),
        (5, "我们都知道，上海是一座很大的城市。"),
    ]
    found = decontaminate.passages(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == [(n, n, 0) for n in range(1, 5)]
    assert decontaminate.words("Ein É-Wort, naïve 中文x") == [w.encode() for w in ("ein", "É", "wort", "naïve", "中", "文", "x")]


def test_long_items_take_bounded_memory():
    rng = random.Random(3)
    items = [(n, " ".join(f"w{rng.randrange(40_000)}" for _ in range(1000))) for n in range(40)]
    finder = decontaminate.Finder(items)
    assert sum(a.nbytes for a in vars(finder).values() if hasattr(a, "nbytes")) < 8 << 20
    assert all(n * decontaminate.at_once(n) <= decontaminate.WINDOW_WORDS for n in (1, 59, 1000, 100_000))
    changed = items[7][1].split()
    changed[100:110] = ["other"] * 10
    assert [(i, e) for _, i, e, *_ in finder.find(["before " + " ".join(changed) + " after"])] == [(7, 10)]


def test_licences(odd, empty):
    got = {r["doc_id"]: r for r in licences.scan_licences(odd).filter("doc_id > 3").collect()}
    assert all(r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(t))) for i, t in pairs(odd) if i and i > 3 for r in [got[i]])
    assert licences.scan_licences(empty).collect() == []


LICENCES = [
    ("Licensed under the Apache License, Version 2.0.", "apache", "apache", 3),
    ("CC  BY-NC 4.0. licensed under cc-by-nc 4.0", "cc-by", "cc-by,cc-by-nc", 0),
    ("THE MIT-License and gnu General public\nlicense", "gpl,mit", "gpl,mit", 1),
    ("gnu lesser general public license", "", "lgpl", None),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and all associated "
     "documentation files (the Software), to deal in the Software without restriction", "", "mit", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "", "cc-by-nc", None),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "", "cc-by-sa", None),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "", "cc-by-nc-nd", None),
    ("Creative Commons Attribution-Non Commercial-Share Alike 4.0 International License", "", "cc-by-nc-sa", None),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "", "cc-by", None),
    ("This work is licensed under the GNU Affero General Public License version 3", "", "agpl", None),
    ("This work is licensed under the GNU General Public License version 3", "gpl", "gpl", 6),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation", "", "lgpl", None),
    ("BSD 3-Clause License", "", "bsd", None),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies.", "", "isc", None),
    ("released under the MIT license. This work is licensed under the GNU Affero General Public License version 3", "mit", "agpl,mit", 3),
    ("the license of the public", "", "", None), (None, "", "", None), ("mit", "", "", None), ("é" * 50_000, "", "", None),
]


def test_licence_labels(spark):
    rows = spark.createDataFrame([(n, t[0]) for n, t in enumerate(LICENCES)], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"], r["first_word"], r["score"]) for r in licences.scan_licences(rows).collect()}
    assert {k: v[:3] for k, v in got.items()} == {n: t[1:] for n, t in enumerate(LICENCES)}
    assert got[0][3] == 1.0 and got[4][3] >= 0.75 and got[len(LICENCES) - 3][3] == 0


def test_phrases_of_one_word(spark):
    rows = spark.createDataFrame([(1, "a Beerware thing, beerware")], "doc_id long, text string")
    got = licences.scan_licences(rows, {"beerware": "beer"}).first()
    assert (got["n_base"], got["first_word"], got["last_word"], got["labels"]) == (2, 1, 3, "beer")


def test_base_columns_of_the_query(spark, given):
    phrases = [(p.split(), label) for p, label in licences.PHRASES.items()]
    got = {r["doc_id"]: r for r in queries.op3_licence_scan(spark, SF).collect()}
    for doc_id, text in given:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(text))
        found = [(i, label) for i in range(len(words)) for p, label in phrases if words[i : i + len(p)] == p]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in found), default=None), max((i for i, _ in found), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert {label for _, label in found} <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_phrases_in_any_words():
    import random

    rng, scanner = random.Random(1), licences.Scanner(licences.PHRASES, licences.TEMPLATES)
    pool = "gnu general public license apache cc by mit the under x".split()
    for _ in range(300):
        text = [rng.choice(pool) for _ in range(rng.randrange(30))]
        want = sorted((i, p) for p, phrase in enumerate(licences.PHRASES) for i in range(len(text)) if text[i : i + len(phrase.split())] == phrase.split())
        assert sorted((b[0], b[2]) for b in scanner.scan(" ".join(text))[1]) == want


def test_language(spark, odd, empty):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    model = language.fit(odd)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows} == {"en", "de", "und"}
    assert {r["text"] for r in rows if r["lang_pred"] == "und"} == {None, "", "  \n", "12345 !!"} and all(0 <= r["score"] <= 1 for r in rows)
    assert language.known(odd, model).schema == odd.schema and language.known(odd, model).count() == sum(r["lang_pred"] != "und" for r in rows)
    filled = sorted(((r["doc_id"], r["text"], r["lang"]) for r in language.known(odd, model).collect()), key=repr)
    assert filled == sorted(((r["doc_id"], r["text"], r["lang"] or r["lang_pred"]) for r in rows if r["lang_pred"] != "und"), key=repr)
    nothing = language.fit(empty)
    assert nothing.langs == [] and language.known(odd, nothing).count() == language.known(odd, model).count()
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_language_scores_do_not_depend_on_the_batch(spark):
    texts = ["the quick brown fox", "x" * (language.PIECE + 5), "der schnelle braune fuchs ä", "ab " * language.PIECE]
    model = language.fit(spark.createDataFrame([(1, "the fox", "en"), (2, "der fuchs", "de")], "doc_id long, text string, lang string"))
    together, alone = model.predict(texts), [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and together[1] == pytest.approx([a[1][0] for a in alone])


PII = [
    "a@b.co, x.y@z.org_m@n.io", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 00001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "41111111111111111111111111", "+31 (0)20 123-4567 +1234 +49.170.1234567--", "1 " * 3000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", None, "",
    "é@é.nl tel +31 20 1234 567é", "@" * 2000, "1." * 4000, "a" * 100_000, "9" * 100_000 + "@x.y", "+1" * 500 + "+" + "(" * 50_000,
    "5500-0000-0000-0004, mail: a+b@c-d.e.f.", "1.2.3.4@5.6", "+12345678901 234567890123",
]


def test_pii(spark, given, odd, empty):
    rows = [(n, t) for n, t in enumerate(PII)]
    for rows, df in ((rows, spark.createDataFrame(rows, "doc_id long, text string")), (given, spark.read.parquet(f"{SF}/documents.parquet"))):
        got = {r["doc_id"]: r for r in pii.summary(pii.find_pii(df)).collect()}
        for doc_id, text in rows:
            spans = brute.pii_base(text)
            assert got[doc_id]["base_sha256"] == brute.sha(brute.spans_joined(spans)), (text or "")[:60]
            assert [got[doc_id][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(empty).collect() == []


def test_pii_of_the_method(spark):
    texts = ["IBAN NL91ABNA0417164300 x", "NL91ABNA0417164301", "ssn: 123-45-6789", "nr 123-45-6789", "DE89 3704 0044 0532 0130 00"]
    got = pii.summary(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [r["spans"] for r in got.orderBy("doc_id").collect()] == ["iban:5:23", "", "ssn:5:16", "", "iban:0:27"]


def test_masking(spark, odd):
    rows = spark.createDataFrame([("é a@b.co 1.2.3.4!", "s"), (None, "s"), ("4111111111111111", "s")], "text string, spans string")
    assert [tuple(r) for r in pii.masked(rows).collect()] == [("é [EMAIL] [IP]!", "s"), (None, "s"), ("[CARD]", "s")]
    assert pii.masked(odd).schema == odd.schema and pii.masked(odd).exceptAll(odd).count() == 1


SECRETS = [
    "password=abcdefghijkl", "PASSWD : \"abc\"", "api_key='0123456789ab' ApiKey=0123456789abcdef", "token==========", "AKIAABCDEFGHIJKLMN AKIAABC", None, "",
    "secret" + " " * 50_000 + "= abcdefghijklmn", "f" * 60_000, "deadbeefdeadbeef" * 3 + "g" + "0" * 15, "Token = é secret:'a/b+c.d-e_f=='", "password=" * 3000,
]


def test_secrets(spark, given, odd, empty):
    rows = [(n, t) for n, t in enumerate(SECRETS)] + [(None, "AKIAABCDEFGHIJKLMN"), (4, "AKIAABCDEFGHIJKLMN")]
    own = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    for rows, found in ((rows, own), (given, secret_scan.find_secrets(spark.read.parquet(f"{SF}/documents.parquet")))):
        want = sorted((str(i), brute.sha(brute.spans_joined(brute.secrets_base(t)))) for i, t in rows)
        got = secret_scan.summary(found).collect()
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    assert secret_scan.find_secrets(odd).count() == odd.count() and secret_scan.find_secrets(empty).collect() == []


def test_secrets_of_the_method(spark):
    texts = ["x ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-a", "eyJhbGciOiJI.eyJzdWIiOiIx.abcd", "sk_live_" + "Z" * 16, "AIza" + "x" * 35]
    got = secret_scan.summary(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    kinds = [r["spans"].split(":")[0] for r in got.orderBy("doc_id").collect()]
    assert kinds == ["github", "private_key", "slack", "jwt", "stripe", "google"]


def random_text(seed, n):
    rng = random.Random(seed)
    parts = ["me@example.org", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "word", "é", "\U0001f600", "mail to", "x" * 50, "\n", "ssn 123-45-6789", "999.1.1.1"]
    return " ".join(rng.choice(parts) for _ in range(n))


def plain_mask(text):
    at, out = 0, []
    for start, _, end, kind in sorted(brute.pii_base(text)):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
            at = end
        at = max(at, end)
    return "".join(out) + text[at:]


def test_texts_with_many_matches(spark, monkeypatch):
    """Chunks of matches and pieces of text, some of each, against plain versions."""
    monkeypatch.setattr(spans, "CHUNK", 7)
    monkeypatch.setattr(spans, "PIECE", 5)
    texts = [random_text(n, size) for n, size in enumerate([0, 1, 5, 6, 7, 8, 30, 300, 900])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = [k for k in pii.KINDS if k.base]
    for r in pii.summary(pii.find_pii(df, base), base).collect():
        assert r["spans"] == brute.spans_joined(brute.pii_base(texts[r["doc_id"]]))
    for r in pii.masked(df, base).collect():
        assert r["text"] == plain_mask(texts[r["doc_id"]])
    # What is near a match may hold other matches: both numbers have their word before them.
    near = spark.createDataFrame([(1, "ssn 123-45-6789, 123-45-6788 and 123-45-6787" + " " * 40 + "123-45-6786")], "doc_id long, text string")
    assert pii.summary(pii.find_pii(near)).first()["spans"].count("ssn:") == 3


def test_time_follows_the_matches(spark):
    """400,000 matches in one text."""
    n = 400_000
    one = lambda part: spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(part), n).alias("text"))
    start = time.time()
    assert pii.summary(pii.find_pii(one("ab@cd.ef "))).first()["n_email"] == n
    assert pii.masked(one("ab@cd.ef ")).select(F.md5("text")).first()[0] == hashlib.md5(b"[EMAIL] " * n).hexdigest()
    assert secret_scan.summary(secret_scan.find_secrets(one("0123456789abcdef0123\n"))).first()["n_hex"] == n
    assert time.time() - start < 300  # the squares of these took hours


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") == []
    assert secret_scan.trigram_query("abcd|xyz") == [[["abc", "bcd"], ["xyz"]]]
    assert secret_scan.trigram_query("ab?cd[0-9]key") == [[["abc", "bcd"], ["acd"]], [["key"]]]
    assert secret_scan.trigram_query("(a|bcd)x*") == []


def test_decontamination(spark, given, odd, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    benchmark = spark.createDataFrame([*items, (900, None), (901, ""), (902, "..."), (903, " ".join(f"w{n}" for n in range(40)))], "item_id long, text string")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    joined = lambda t: " " + b" ".join(licences.words(t)).decode() + " "
    want = {(d, i) for d, t in given for i, b in items if joined(b) in joined(t)}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.passages(documents, benchmark).collect()}
    w = [f"w{n}" for n in range(40)]
    edited = [
        (1, w, 0), (2, ["a", *w[:10], "x", *w[11:], "b"], 1), (3, [*w[:5], *w[7:20], "y", "z", *w[20:30], "q", *w[31:]], 5),
        (4, [*w[:9], *"abcdefg", *w[16:]], None), (5, w[:30], None), (6, w[3:], 3), (7, ["W0,"] + w[1:], 0),
    ]
    rows = spark.createDataFrame([(i, " ".join(t), "s") for i, t, _ in edited] + [(8, None, "s"), (9, "", "s"), (None, " ".join(w), "s")], "doc_id long, text string, edits string")
    got = {r["doc_id"]: (r["item_id"], r["edits"]) for r in decontaminate.passages(rows, benchmark).collect()}
    assert got == {**{i: (903, e) for i, _, e in edited if e is not None}, None: (903, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(rows, benchmark).collect()} == {4, 5, 8, 9}
    assert decontaminate.clean(odd, benchmark).schema == odd.schema and decontaminate.clean(odd, benchmark).count() == odd.count()
    no_items = benchmark.limit(0)
    assert decontaminate.clean(odd, no_items).count() == odd.count() and decontaminate.passages(odd, no_items).collect() == []
    assert decontaminate.clean(empty, benchmark).collect() == []


def test_edit_distances():
    """The distance of the best part, against a plain table, whatever the edits."""
    import random

    rng = random.Random(3)
    item = [f"w{n}" for n in range(24)]
    finder = decontaminate.Finder([(1, " ".join(item))])
    for _ in range(200):
        text = list(item)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice([[], ["zz"]])
        text = [f"p{n}" for n in range(rng.randrange(9))] + text + ["w3", "q"][: rng.randrange(3)]
        table = [0] * (len(text) + 1)
        for k, word in enumerate(item):
            diagonal, table[0] = table[0], k + 1
            for j, other in enumerate(text):
                diagonal, table[j + 1] = table[j + 1], min(diagonal + (word != other), table[j] + 1, table[j + 1] + 1)
        got = finder.find([" ".join(text)])
        assert [g[2] for g in got] == [min(table)] if min(table) <= decontaminate.allowed(24) else not got


def test_mixing(spark, odd, empty):
    plan = mixing.mix_plan(odd).collect()
    sources = {}
    for r in plan:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    size = {s: sum(r["size"] for r in sources[s]) for s in order}
    target, open_, rest = {}, list(order), 1.5 * sum(size.values())
    weight = dict(zip(order, [3, 1, 2, 3, 1, 2]))
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            open_.remove(s)
    target.update({s: level * weight[s] for s in open_})
    assert all(r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] for r in plan)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2 for r in plan)
    mixed = mixing.mix(odd)
    assert mixed.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    assert mixed.count() == sum(r["copies"] for r in plan) and mixed.exceptAll(mixing.mix(odd)).count() == 0
    assert mixing.mix(empty).collect() == []


def test_mixed_words_come_near_the_targets(spark):
    rows = queries.op10_mixing(spark, "/root/testdata/sf0.1").groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(rows) > 1 and all(abs(r["taken"] - r["target"]) <= 0.06 * r["target"] for r in rows)
