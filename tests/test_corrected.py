"""The query of corrected texts over rows of its own."""

from pyspark.sql import functions as F

from workload import label_queries as lq


def test_texts_are_made_once(spark, monkeypatch):
    made, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = f"doc_id long, gold {lq.LISTED}, proposed {lq.LISTED}"
    rows = [(n, [("onderwerp", "a")] * (n % 2), [("beleving", "b")]) for n in range(6)]
    texts = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    monkeypatch.setattr(lq, "arriving", lambda *_: (texts, lambda: spark.range(1)))
    monkeypatch.setattr(lq, "rounded", lambda scores: scores)
    write = lq.write_files

    def noted(rows, folder, version):
        write(rows, folder, version)
        stored = spark.read.parquet(f"{folder}/in").filter(F.col("version") == version)
        written.append((version, sorted(r["doc_id"] for r in stored.collect())))

    monkeypatch.setattr(lq, "write_files", noted)
    lq.evaluate_corrected(spark, "unused")
    assert written == [(1, [1, 3, 5]), (2, [0, 1, 2, 3, 4, 5]), (0, [1, 3, 5])]
    assert made.value == 6
