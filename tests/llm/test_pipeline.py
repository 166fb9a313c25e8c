import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == names and 0 < docs.count() <= kept
        kept = docs.count()
    assert docs.where(F.col("text").rlike(r"@mail\d+\.example\.com")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == kept


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "piece"]


LONG = "plain words that go on " * 20_000


def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, ties, one id with two texts, a column with a name used inside."""
    same = " ".join(f"word{j}" for j in range(60))
    rows = [(1, same, "en", "s", len(same), 5), (1, same, "en", "s", len(same), 5), (2, None, None, None, None, None), (3, "", "en", "s", 0, 6), (None, same, "en", "s", len(same), 7), (4, LONG, "en", "s", len(LONG), 8),
            (5, same + " end", "en", "s", len(same) + 4, 9), (6, "mail a.person@mail.com now", "en", "s", 26, 10), (6, "another text of this id", "en", "s", 23, 11)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3)


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    due = {"toxicity": 9, "ngram_jaccard_join": 7, "benchmark_decontamination": 9, "pii": 9}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == due[name], name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = sorted((r["doc_id"] or 0, r["score"] or 0) for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect())
    assert kept == [(0, 7), (1, 5), (2, 0), (3, 6), (4, 8), (6, 10), (6, 11)]
    text = {r["score"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()}
    assert "a.person" not in text[10][0] and text[10][1] == len(text[10][0]) and text[8][0] == LONG and text[None] == (None, None)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0 and pieces.where("piece = 0").count() == 9
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
