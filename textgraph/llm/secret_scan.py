"""Secret scans with a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query: every clause is a
set of strings one of which must occur, and a string occurs only where all its
trigrams do. The index has postings (trigram, document) for the trigrams of the
queries. Postings are intersected per string, strings united per clause, clauses
intersected per rule; only candidates are verified with the expression. A rule
without a mandatory trigram scans every text.

Everything is built-in functions. Postings are counted where the text is before
they are shuffled; texts move only if the candidates are too many for Spark to
broadcast them.

Defined results: a null text counts as empty; repeated rows and ids are judged
row by row; null ids keep their rows (they are verified like candidates); places
are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.llm import spans as S
from textgraph.session import run_folder, stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # read by Java; what it derives its trigrams from, too
    least: int = 0  # characters of the group below
    group: int = 0
    starts: str = ""  # a look-behind that changes no match, against long runs
    base: bool = False

    @property
    def java(self) -> str:
        return self.starts + self.pattern


# The base rules, then well-known token forms.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 16, starts=r"(?<![0-9a-f])", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
]
MOST_STRINGS = 64  # of a clause; longer lists end the string instead


def _exact(node) -> set[str] | None:
    """All strings a parsed part can match, lowered, if they are few."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}
    if op is sre.SUBPATTERN:
        return _joined(value[-1])
    if op is sre.BRANCH:
        parts = [_joined(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] == value[1] == 1 or op is sre.MAX_REPEAT and value[:2] == (0, 1):
        inner = _joined(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _joined(parts) -> set[str] | None:
    whole = {""}
    for part in parts:
        found = _exact(part)
        if found is None or len(whole) * len(found) > MOST_STRINGS:
            return None
        whole = {a + b for a, b in product(whole, found)}
    return whole


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses, each a list of strings, each the list of its trigrams."""
    clauses, run = [], {""}

    def close() -> None:
        if min(map(len, run)) >= 3:
            strings = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted(sorted(s) for s in strings if not any(t < s for t in strings)))

    for part in _parser.parse(pattern):
        found = _exact(part)
        if found is None or len(run) * len(found) > MOST_STRINGS:
            close()
            run = {""} if found is None else found
        else:
            run = {a + b for a, b in product(run, found)}
    close()
    return clauses


def candidates(documents: DataFrame, queries: dict[str, list]) -> DataFrame:
    """``doc_id, kinds``: the rules whose trigram query a document meets."""
    spark = documents.sparkSession
    terms = [
        (kind, c, s, trigram, len(string), len(clauses))
        for kind, clauses in queries.items() for c, clause in enumerate(clauses)
        for s, string in enumerate(clause) for trigram in string
    ]
    wanted = spark.createDataFrame(terms, "kind string, clause int, string int, trigram string, need int, clauses int")
    trigrams = F.array(*map(F.lit, sorted({t[3] for t in terms})))
    present = S.bound(F.lower(F.col("text")), lambda low: F.filter(trigrams, lambda t: F.contains(low, t)))
    postings = documents.select("doc_id", F.explode(present).alias("trigram"))
    met = (
        postings.join(F.broadcast(wanted), "trigram")  # a row per rule and trigram, fixed by the rules
        .groupBy("doc_id", "kind", "clauses", "clause", "string", "need").agg(F.count_distinct("trigram").alias("n"))
        .filter(F.col("n") == F.col("need"))
    )
    rules = met.groupBy("doc_id", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).filter(F.col("n") == F.col("clauses"))
    return rules.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # as many as there are rules


def find_secrets(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, text, spans`` per row, spans by start and rule."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    indexed = stage(candidates(rows, queries), run_folder(spark, "secret-candidates"))
    rows = rows.join(indexed, "doc_id", "left")
    kinds, spans = F.coalesce("kinds", F.array().cast("array<string>")), []
    for rank, rule in enumerate(rules):
        where = F.array_contains(kinds, rule.kind) | F.col("doc_id").isNull() if rule.kind in queries else None
        rows = rows.withColumn(f"_m{rank}", S.matches(F.col("text"), rule.java, where))
    for rank, rule in enumerate(rules):
        spans.append(_verified(S.places(F.col("text"), rule.java, F.col(f"_m{rank}")), rule, rank))
    return rows.select("doc_id", "text", S.in_order(spans).alias("spans"))


def _verified(places: Column, rule: Rule, rank: int) -> Column:
    def long_enough(place: Column) -> Column:
        text = F.regexp_extract(place["text"], rule.pattern, rule.group) if rule.group else place["text"]
        return F.length(text) >= rule.least

    return S.as_spans(F.filter(places, long_enough) if rule.least else places, rule.kind, rank)


def summary(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    return found.select(
        "doc_id", *(S.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in base),
        F.sha2(S.listed(S.of_kinds(F.col("spans"), base)), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"),
    )
