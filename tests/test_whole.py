"""Queries over whole tables and whole texts, on small tables against brute force."""

import gzip
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import canon, stats
from ruleloom.functions import text as X
from ruleloom.operators import dedup, sampling
from ruleloom.plans import catalog
from ruleloom.sources import records

QUERIES = catalog.queries()


def near(a, b):
    """One letter changed, put in or left out, or two neighbours swapped."""
    letters = "0123456789"
    return b in ({a} | {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in letters}
                 | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1)})


def test_near_misses_of_all_ids(spark, tmp_path):
    suppliers, customers = [1, 77, 101, 250, 4_321, 123_456], [1, 10, 52, 77, 205, 251, 4_312, 23_456, 100_001, 123_456, 123_465, 200_077]
    spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in suppliers], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in customers], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for a in (f"{k:09d}" for k in suppliers):
        if hits := sorted(b for b in (f"{k:09d}" for k in customers) if near(a, b)):
            want[a] = (len(hits), hits[0])
    assert "000123456" in want and "000000250" in want
    assert {r["a"]: (r["n"], r["least"]) for r in QUERIES["near_miss_all"](spark, str(tmp_path)).collect()} == want


def test_repeated_ids_of_all_orders(spark, tmp_path):
    spark.createDataFrame([(1, 5, 6), (199, 7, 5), (200, 8, 9), (7_000, 8, 6)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, QUERIES["referenced_twice_all"](spark, str(tmp_path)).collect())) == [(5, 2), (6, 2), (8, 2)]


def test_credentials_anywhere_in_a_text(spark, tmp_path):
    far = "plain words " * 100
    texts = {1: (far + "sk-abcdefgh1234", far + "[redacted]"), 2: (far, far), 3: ('Authorization: Basic dXNlcjpwYXNz, more', "Authorization: [redacted], more"), 4: ('{"authorization": "abc def"}', '{"authorization": [redacted]}'),
             5: (far + "authorization=xyz " + far, far + "authorization=[redacted] " + far), 6: ("Authorization: Bearer ab.cd end", "Authorization: [redacted] end"), 7: (None, None)}
    spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: hashlib.sha256(clean.encode()).hexdigest() for k, (t, clean) in texts.items() if t != clean}
    assert {r["doc_id"]: r["digest"] for r in QUERIES["redacted_whole"](spark, str(tmp_path)).collect()} == want


def test_lines_are_numbered_and_missing_files_told(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nno\n[1]\n{"k": 2}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"k": {i}}}\n' for i in range(5_000)) + "bad\n")
    got = records.audited_lines(spark, str(tmp_path)).where("problem is not null").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["problem"]) for r in got) == [("a.jsonl", 3, "not json"), ("a.jsonl", 4, "not an object"), ("b.jsonl", 5001, "not json")]
    assert [r["problem"] for r in records.audited_lines(spark, str(tmp_path / "none")).collect()] == ["missing file"]
    assert records.blind(spark, str(tmp_path / "a.jsonl"), "k long").columns == ["k"]


def test_sinks_templates_and_packed_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"b": "x"}), (2, {"a": "y", "c": "z"})], "i int, m map<string,string>")
    assert records.union_of_keys(rows, "m").columns == ["a", "b", "c"]
    for n in (1, 2):
        records.write_replacing(rows.select("i").limit(n), str(tmp_path / "out"))
        assert spark.read.json(str(tmp_path / "out")).count() == n
    (tmp_path / "t").mkdir()
    for name, text in {"b.json": "[1]", "a.json": "[]", "c.json": "{}", "d.txt": "[]"}.items():
        (tmp_path / "t" / name).write_text(text)
    assert [r["name"] for r in records.templates(spark, str(tmp_path / "t")).collect()] == ["a.json", "b.json"]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one.gz").write_bytes(gzip.compress(b"abc" * 1000) + gzip.compress(b"end"))
    (tmp_path / "z" / "two.gz").write_bytes(b"no gzip")
    got = {r["file"].rsplit("/", 1)[1]: (r["digest"], r["bytes"]) for r in records.unpacked_checksums(spark, str(tmp_path / "z")).collect()}
    assert got["one"] == (hashlib.sha256(b"abc" * 1000 + b"end").hexdigest(), 3003) and got["two"][0] is None
    kept = records.last_of_key(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, at int"), "k", F.col("at"))
    assert sorted((r["k"], r["v"]) for r in kept.collect()) == [(1, "b"), (2, "c")]


def test_white_space_timestamps_and_spans(spark):
    blanks = ["\u00a0x\u2028", "\x0b x\ufeff", "\u3000", "\u00a0", None]
    df = spark.createDataFrame([(b,) for b in blanks], "t string")
    assert [r[0] for r in df.select(X.blank_to_null(F.col("t"))).collect()] == ["x", "x", None, None, None]
    stamps = {"2024-03-01T10:00:00Z": 0, "2024-03-01T10:00:00": 0, "2024-03-01T12:00:00.5+02:00": 500, "2024-03-01T12:00:00.1234567+0200": 123, " 2024-03-01T10:00:01.25Z ": 1250, "2024-03-01 10:00:00": None, "2024-13-01T10:00:00Z": None, "x": None}
    df = spark.createDataFrame([(s, "2024-03-01T10:00:00Z") for s in stamps], "s string, z string")
    got = df.select("s", X.span_ms(X.parse_timestamp(F.col("z")), X.parse_timestamp(F.col("s"))).alias("ms")).collect()
    assert {r["s"]: None if r["ms"] is None else int(r["ms"]) for r in got} == stamps


def test_bodies_of_two_models_have_one_hash(spark):
    df = spark.createDataFrame([("m1", "a"), ("m2", "a"), ("m1", "b")], "m string, e string")
    body = canon.chat_body(F.col("m"), canon.instruction_text(F.lit("Decide."), "Answer in JSON."), F.col("e"))
    one, two, other = (r[0] for r in df.select(canon.prompt_hash(body)).collect())
    assert one == two != other and "Decide. Answer in JSON." in df.select(body).first()[0]


def test_ranks_and_running_values_bucket_by_bucket(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 200, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    got = {r["v"]: (r["rn"], r["n"]) for r in sampling.ranked(df, ["g"], ["o"], F.expr("o div 10"), "rn", "n").collect()}
    most = {r["v"]: r["m"] for r in sampling.carried(df, ["g"], ["o"], F.expr("o div 10"), "max", F.col("v"), "m").collect()}
    for g, o, v in rows:
        before = [x for x in rows if x[0] == g and x[1] < o]
        assert got[v] == (len(before) + 1, sum(x[0] == g for x in rows)) and most[v] == max((x[2] for x in before), default=None)


def test_contained_items_of_any_length(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None), (3, ""), (4, "xx ab")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab"), (2, "b c"), (3, "zz"), (4, None), (5, ""), (6, "ab")], "item_id long, text string")
    got = dedup.contained(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert {tuple(r) for r in got} == {(1, 1), (1, 2), (1, 6), (4, 1), (4, 6)}


def test_mcnemar_of_many(spark):
    df = spark.createDataFrame([(0, 0), (1, 8), (5000, 5100), (30, 2)], "b long, c long")
    got = [r[0] for r in df.select(stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()]
    tail = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    assert got == pytest.approx([1.0, tail(1, 8), tail(5000, 5100), tail(30, 2)])
