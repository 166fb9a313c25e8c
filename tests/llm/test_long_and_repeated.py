"""Very long training texts, repeated ids while fitting, and archives that another attempt has finished."""

import time

import pytest
from pyspark.sql import functions as F

from ruleloom.llm import language, toxicity, warc


def test_pieces_of_a_text_of_20_megabytes(spark):
    df = spark.range(1).select(F.expr("repeat('lange wörter aus einem text. ', 700000)").alias("text"), F.lit("de").alias("lang"))
    began = time.perf_counter()
    got = language.sample_pieces(df, "text", "lang").collect()
    assert len(got) == language.PIECES and all(0 < len(r["t"]) <= language.PIECE for r in got)
    assert time.perf_counter() - began < 60


def test_pieces_are_what_cutting_gives(spark):
    texts = ["a\nb" * 700, "ü𝄞x " * 999, "kurz", "y" * language.PIECE]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    want = sorted(t[i:i + language.PIECE] for t in texts for i in range(0, len(t), language.PIECE))
    assert sorted(r["t"] for r in language.sample_pieces(df, "text", "lang").collect()) == want


def _rows(spark):
    docs = [(i, f"you awful fool number{i % 3}" if i % 4 == 0 else f"a kind word about gardens number{i % 3}") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    return docs, labels


def test_a_repeated_id_gives_one_training_row(spark):
    docs, labels = _rows(spark)
    d = spark.createDataFrame(docs + [docs[0]] * 500, "doc_id long, text string")
    l = spark.createDataFrame(labels + [labels[0]] * 500, "doc_id long, toxic int")
    rows, totals = toxicity.training_rows(d, l)
    assert (rows.count(), totals) == (200, {1: 550, 0: 150})
    assert rows.where("times > 1").select("i", "times").collect() == [(0, 501)]
    model = toxicity.fit_toxicity(d, l)
    told = spark.createDataFrame([(0, "awful fool"), (1, "kind word about gardens")], "doc_id long, text string")
    toxic, clean = (r["score"] for r in toxicity.score_toxicity(told, model).orderBy("doc_id").collect())
    assert toxic > 0.9 and clean < toxic - 0.1


def test_repeated_labels_weigh_as_often(spark):
    docs, labels = _rows(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    once, twice = (toxicity.fit_toxicity(d, spark.createDataFrame(labels * n, "doc_id long, toxic int")) for n in (1, 2))
    assert (once["terms"] == twice["terms"]).all() and abs(once["w"] - twice["w"]).max() < 1e-9
    more = toxicity.fit_toxicity(d, spark.createDataFrame(labels + [x for x in labels if x[1]] * 9, "doc_id long, toxic int"))
    empty = lambda m: toxicity.score_toxicity(spark.createDataFrame([("",)], "text string"), m).first()["score"]
    assert empty(more) > empty(once)


class _Refusing:
    """A file system that refuses taken names."""

    def __init__(self, system):
        self.system = system

    def move(self, a, b):
        if self.system.get_file_info(b).type.name != "NotFound":
            raise OSError("name is taken")
        self.system.move(a, b)

    def __getattr__(self, name):
        return getattr(self.system, name)


def test_a_second_attempt_leaves_the_first_ones_file(tmp_path):
    from pyarrow import fs

    system = _Refusing(fs.LocalFileSystem())
    for n in ("p", "q"):
        (tmp_path / n).write_bytes(b"same")
        warc._settle(system, str(tmp_path / n), str(tmp_path / "a.warc.gz"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.warc.gz"]
    with pytest.raises(OSError):
        warc._settle(fs.LocalFileSystem(), str(tmp_path / "none"), str(tmp_path / "b.warc.gz"))
