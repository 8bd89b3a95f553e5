"""JSON-LD documents: extract, add and read terms, flatten to triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textgraph.functions import text
from textgraph.functions.joins import lookup_join, row_join
from textgraph.operators.labels import reading_signal
from textgraph.session import spread

# Levels of objects and lists in a document: Spark's own JSON reader goes no deeper.
MAX_DEPTH = 1000
OBJECT = "map<string,variant>"
ARRAY = "array<variant>"


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", ARRAY)


def parsed_object(json_ld: Column) -> Column:
    """The parsed text; NULL unless it is a JSON object without repeated keys, at most ``MAX_DEPTH`` levels deep."""
    return F.when(text.strip(json_ld).startswith("{"), F.try_parse_json(json_ld))


def minimal_document() -> Column:
    """The document of a text whose extraction failed."""
    return F.to_json(F.create_map(F.lit("@context"), F.lit("https://schema.org"), F.lit("@type"), F.lit("Thing")))


def extract_documents(answers: DataFrame, response: str = "response") -> DataFrame:
    """The JSON object inside each answer; answers without one have a reject_reason."""
    return answers.withColumn("json_ld", text.json_object(F.col(response))).withColumn(
        "reject_reason", F.when(F.col("json_ld").isNull(), "no JSON object in the answer")
    )


def term_lists(labels: DataFrame) -> DataFrame:
    """Labels of a text, in order, as one list of terms.

    ``labels`` is (doc_id, pos, label, main_topic), where any type that sorts may
    be the pos; labels without a topic are left out. The list goes into one
    document, so it is as large as a cell.
    """
    term = F.struct("pos", "label", "main_topic")
    return labels.filter("main_topic IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(term)).alias("terms"))


def add_terms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Append a DefinedTerm to ``about`` for each label with a topic.

    ``about`` is created if absent, and made a list if it is one value and a
    label comes to it. Text that is no JSON object (or repeats a key) gets a
    reject_reason and stays as it is.
    """
    joined = row_join(docs, term_lists(labels), "doc_id", "left")
    parsed = joined.withColumn("_v", parsed_object(F.col("json_ld")))
    parsed = parsed.withColumn("_about", F.try_variant_get("_v", "$.about", "variant"))
    # The map read from the text keeps the order of its keys.
    fields = F.from_json("json_ld", OBJECT)
    about = F.col("_about")
    held = F.when(about.isNull(), F.array().cast(ARRAY)).otherwise(F.coalesce(as_array(about), F.array(about)))
    new = F.transform(
        "terms",
        lambda t: F.to_variant_object(
            F.struct(
                F.lit("DefinedTerm").alias("@type"),
                t["label"].alias("name"),
                F.struct(F.lit("DefinedTermSet").alias("@type"), t["main_topic"].alias("name")).alias("inDefinedTermSet"),
            )
        ),
    )
    merged = F.map_concat(
        F.map_filter(fields, lambda k, _: k != "about"),
        F.create_map(F.lit("about"), F.to_variant_object(F.concat(held, F.coalesce(new, F.array().cast(ARRAY))))),
    )
    unchanged = F.col("terms").isNull() & about.isNotNull()
    return (
        parsed.withColumn("reject_reason", F.when(F.col("_v").isNull(), "no JSON object"))
        .withColumn("json_ld", F.when(F.col("_v").isNull() | unchanged, F.col("json_ld")).otherwise(F.to_json(merged)))
        .drop("_v", "_about", "terms")
    )


def document_terms(docs: DataFrame) -> DataFrame:
    """Terms of each document as a list, or the reason why the row is rejected.

    The two columns leave as output of a generator: a filter on them is then not
    pushed below it, which would parse each document several times.
    """
    parsed = docs.withColumn("_v", parsed_object(F.col("json_ld"))).withColumn(
        "_about", F.try_variant_get("_v", "$.about", "variant")
    )
    about = F.col("_about")
    items = F.coalesce(as_array(about), F.array(about))
    read = lambda item, path: F.try_variant_get(item, path, "string")
    terms = F.transform(
        items,
        lambda item, i: F.struct(
            i.cast("long").alias("pos"),
            read(item, "$.name").alias("label"),
            read(item, "$.inDefinedTermSet.name").alias("main_topic"),
        ),
    )
    reason = (
        F.when(F.col("_v").isNull(), "no JSON object")
        .when(about.isNull(), "no about")
        .when(F.exists("terms", lambda t: t["main_topic"].isNull()), "term without a term set")
        .when(F.exists("terms", lambda t: t["label"].isNull()), "term without a name")
    )
    listed = parsed.withColumn("terms", F.when(about.isNotNull(), terms))
    once = F.explode_outer(F.array(F.struct("terms", reason.alias("reject_reason")))).alias("_read")
    kept = [c for c in docs.columns if c not in ("terms", "reject_reason")]
    return listed.select(*kept, once).select(*kept, "_read.terms", "_read.reject_reason")


def term_signals(read: DataFrame, signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``document_terms`` as labels with the signal type of their set."""
    rows = read.filter("reject_reason IS NULL").select(key, F.inline("terms"))
    return lookup_join(rows, reading_signal(signals).select("main_topic", "signal_type"), ["main_topic"], "inner")


def read_terms(docs: DataFrame, signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels out of ``about`` with the signal type of their term set.

    Terms of an unknown set are skipped; rejected documents give no rows.
    """
    return term_signals(document_terms(docs), signals, key)


def rejected_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return document_terms(docs).filter("reject_reason IS NOT NULL").select(key, "reject_reason")


FACT = (
    "path string, node_id string, types array<string>, via string, property string, "
    "kind string, value string, child_types array<string>"
)


def facts(docs: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Flatten nested documents to one row per fact, in one pass.

    The documents stay where they are, or are dealt to ``partitions`` before
    they are parsed: a file with one row group is one task otherwise.

    Columns: keys, path (of the node), node_id, types, via (the property that
    leads to the node), property, kind, value, child_types. Kinds are root (one
    row per document), invalid (instead of root, for text that is no JSON
    object, repeats a key or is nested too deep), type, ref, node and, for plain values, string,
    number, boolean or null. Lists fan out; an object that is only an ``@id`` is
    a ref; numbers keep their text. A document may be ``MAX_DEPTH`` levels deep,
    for ``parsed_object`` as well. An ``@id`` that is no plain value, and a type
    that is none, count as absent.

    An Arrow function, as opening VARIANT level by level took five times
    as long (28 s against 6 s for 140,000 documents on two cores) and needed a
    bound on the depth.
    """
    schema = T.StructType([*docs.select(*keys).schema.fields, *T.DataType.fromDDL(FACT).fields])
    return spread(docs.select(*keys, "json_ld"), partitions, *keys).mapInArrow(_flatten(list(keys), schema.fieldNames()), schema)


def _parser(deepest: int = MAX_DEPTH):
    """Makes the reader of documents; as an inner function it travels by value, too."""

    def parser(number: type):
        """Reads a text as an object, its numbers as ``number`` of their text; None where it is none."""
        import json

        def members(pairs):
            found = dict(pairs)
            if len(found) < len(pairs):
                raise ValueError("a key is repeated")
            return found

        def no_constant(name):
            raise ValueError(f"{name} is not JSON")

        decoder = json.JSONDecoder(
            object_pairs_hook=members, parse_int=number, parse_float=number, parse_constant=no_constant
        )

        def parse(text):
            try:
                found = decoder.decode(text or "")
            except (ValueError, RecursionError):
                return None
            if not isinstance(found, dict):
                return None
            # No deeper than it has brackets.
            return found if text.count("{") + text.count("[") <= deepest or shallow(found) else None

        def shallow(found):
            level = [found]
            for _ in range(deepest):
                if not level:
                    return True
                level = [v for x in level for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, (dict, list))]
            return not level

        return parse

    return parser


def _flatten(keys: list[str], names: list[str], deepest: int = MAX_DEPTH):
    """The Arrow function; it imports what it needs, so it travels alone."""
    parser = _parser(deepest)

    def run(batches):
        import pyarrow as pa

        class Number(str):
            """The text of a number, told apart from a string."""

        parse = parser(Number)

        def plain(value):
            if value is None:
                return "null", None
            if isinstance(value, bool):
                return "boolean", str(value).lower()
            return ("number" if isinstance(value, Number) else "string"), str(value)

        def sound(value):
            if isinstance(value, list):
                return [sound(v) for v in value]
            return value if value is None else value.encode("utf-8", "replace").decode()

        def walk(text):
            """Facts of one document as tuples in the order of the columns."""
            root = parse(text)
            if root is None:
                yield None, None, [], None, None, "invalid", None, []
                return
            left = [("$", root, None, None)]
            while left:
                place, value, name, owner = left.pop()
                if isinstance(value, list):
                    left.extend((f"{place}[{n}]", item, name, owner) for n, item in enumerate(value))
                elif isinstance(value, dict):
                    own_id = value.get("@id")
                    own_id = None if isinstance(own_id, (dict, list)) else plain(own_id)[1]
                    kinds = value.get("@type") or []
                    kinds = kinds if isinstance(kinds, list) else [kinds]
                    kinds = list(dict.fromkeys(str(k) for k in kinds if not isinstance(k, (dict, list))))
                    if owner is None:
                        yield None, own_id, kinds, None, None, "root", None, []
                    elif own_id is not None and len(value) == 1:
                        yield *owner, name, "ref", own_id, []
                        continue
                    else:
                        yield *owner, name, "node", place if own_id is None else own_id, kinds
                    node = (place, own_id, kinds, name)
                    for kind in kinds:
                        yield *node, "@type", "type", kind, []
                    left.extend(
                        (f"{place}.{key}", item, key, node)
                        for key, item in value.items() if key not in ("@id", "@type", "@context")
                    )
                else:
                    yield *owner, name, *plain(value), []

        strings, lists = pa.string(), pa.list_(pa.string())
        kinds = [strings, strings, lists, strings, strings, strings, strings, lists]
        # Small slices, as a document may give many facts.
        for batch in (b.slice(start, 500) for b in batches for start in range(0, b.num_rows, 500)):
            sources, rows = [], []
            for n, text in enumerate(batch.column("json_ld").to_pylist()):
                before = len(rows)
                rows.extend(walk(text))
                sources.extend([n] * (len(rows) - before))
            repeated = batch.select(keys).take(pa.array(sources, pa.int32()))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            try:
                columns = [pa.array(c, t) for c, t in zip(columns, kinds)]
            except UnicodeEncodeError:  # half of a surrogate pair in an escape
                columns = [pa.array([sound(v) for v in c], t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*repeated.columns, *columns], names)

    return run


NODE = (
    "path string, types array<string>, via string, "
    "entries array<struct<property:string,child_types:array<string>>>"
)
INVALID = "@invalid"


def nodes(docs: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """One row per object of a document with what the rules of validation look at, in one pass.

    Columns: keys, path, types, via, entries. An entry is a property the object
    has: once for all values without a type, and for each object with types that it
    leads to, with these as child_types. An object with types has an entry ``@type``;
    other properties with an @ are left out. The first entry of the root has no property.
    Text that is no document is one row with the entry ``INVALID``. Objects without
    entries have no row. What counts as what is as in ``facts``.
    """
    schema = T.StructType([*docs.select(*keys).schema.fields, *T.DataType.fromDDL(NODE).fields])
    return spread(docs.select(*keys, "json_ld"), partitions, *keys).mapInArrow(_nodes(list(keys), schema.fieldNames(), INVALID), schema)


def _nodes(keys: list[str], names: list[str], invalid: str):
    """The Arrow function; it imports what it needs, so it travels alone."""
    parser = _parser()

    def run(batches):
        import pyarrow as pa

        parse = parser(str)

        def sound(value):
            if isinstance(value, list):
                return [sound(v) for v in value]
            return value if value is None else value.encode("utf-8", "replace").decode()

        def kinds_of(value):
            kinds = value.get("@type")
            if type(kinds) is str:
                return [kinds] if kinds else []
            kinds = kinds or []
            kinds = kinds if isinstance(kinds, list) else [kinds]
            return list(dict.fromkeys(str(k) for k in kinds if not isinstance(k, (dict, list))))

        def is_ref(value):
            own = value.get("@id")
            return own is not None and not isinstance(own, (dict, list))

        strings, lists = pa.string(), pa.list_(pa.string())
        for batch in (b.slice(start, 500) for b in batches for start in range(0, b.num_rows, 500)):
            sources, paths, types, vias, ends = [], [], [], [], [0]
            properties, children = [], []
            for n, text in enumerate(batch.column("json_ld").to_pylist()):
                root = parse(text)
                left = [("$", root, None, [] if root is None else kinds_of(root))]
                while left:
                    place, value, via, kinds = left.pop()
                    before = len(properties)
                    if via is None:
                        properties.append(invalid if value is None else None)
                        children.append([])
                    if kinds:
                        properties.append("@type")
                        children.append([])
                    for key, item in () if value is None else value.items():
                        shown = not key.startswith("@")
                        if not isinstance(item, (dict, list)):
                            if shown:
                                properties.append(key)
                                children.append([])
                            continue
                        if key in ("@id", "@type", "@context"):
                            continue
                        items, plain = [(f"{place}.{key}", item)], False
                        while items:
                            at, one = items.pop()
                            if isinstance(one, list):
                                items.extend((f"{at}[{k}]", v) for k, v in enumerate(one))
                            elif isinstance(one, dict):
                                if len(one) == 1 and is_ref(one):
                                    plain = True
                                    continue
                                found = kinds_of(one)
                                left.append((at, one, key, found))
                                if found and shown:
                                    properties.append(key)
                                    children.append(found)
                                plain = plain or not found
                            else:
                                plain = True
                        if plain and shown:
                            properties.append(key)
                            children.append([])
                    if len(properties) > before:
                        sources.append(n)
                        paths.append(None if value is None else place)
                        types.append(kinds)
                        vias.append(via)
                        ends.append(len(properties))
            repeated = batch.select(keys).take(pa.array(sources, pa.int32()))
            columns, kinds = [paths, types, vias, properties, children], [strings, lists, strings, strings, lists]
            try:
                columns = [pa.array(c, t) for c, t in zip(columns, kinds)]
            except UnicodeEncodeError:  # half of a surrogate pair in an escape
                columns = [pa.array([sound(v) for v in c], t) for c, t in zip(columns, kinds)]
            entries = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns[3:], ["property", "child_types"]))
            yield pa.RecordBatch.from_arrays([*repeated.columns, *columns[:3], entries], names)

    return run


def jsonld_triples(docs: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Facts as rows: node path, @id, type, property, value, value_type."""
    return facts(docs, keys, partitions).filter("kind NOT IN ('root', 'invalid')").select(
        *keys, "path", "node_id", F.concat_ws(" ", "types").alias("node_type"),
        "property", "value", F.col("kind").alias("value_type"),
    )
