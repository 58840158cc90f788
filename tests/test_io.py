"""Sources, sinks and streams, with repeated deliveries and restarts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from attestra.sources import readers as S
from attestra.sources import rulesets, writers
from attestra.streaming import intake as W


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp")


def test_submissions_are_files_with_a_signature(spark, folder):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"plain"), ("c.pdf", b"")):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(data)
    files = S.read_submissions(spark, folder).withColumn("batch", F.lit(1))
    rows = {r["path"][-5:]: r for r in S.accept_submissions(files, "batch").collect()}
    # an empty file is not even scanned
    assert [rows[n]["accepted"] for n in ("a.pdf", "b.pdf")] == [True, False] and "c.pdf" not in rows
    assert len(rows["a.pdf"]["sha256"]) == 64 and rows["b.pdf"]["sha256"] is None


def test_oversized_batches_are_rejected(spark):
    files = spark.range(31).select(F.lit(1).alias("batch"), F.lit("%PDF-x").cast("binary").alias("content"), F.lit(6).alias("length"))
    assert S.accept_submissions(files, "batch").where("accepted").count() == 0


RULES = """---
rules:
  - id: R1
    operation: duration
    selector: {type: test}
    params: {minimum_days: 14}
  - id: R2
    operation: expiry
    products: [P]
    params: {start_field: 제조년월일, end_field: 유효기한, duration_field: 저장기간}
    depends_on: {R1: 원액}
---
text
"""


def test_rule_files(spark, folder):
    pytest.importorskip("yaml")
    with open(f"{folder}/rules.md", "w") as out:
        out.write(RULES)
    rules = rulesets.read_rules(spark, folder)
    assert [r.id for r in rules] == ["R1", "R2"] and rules[1].products == ("P",)


@pytest.mark.parametrize("old,new", [("duration", "guess"), ("id: R2", "id: R1"), ("R1: 원액", "R9: 원액"), ("selector:", "selektor:"), ("minimum_days", "minimum_day"), ("id: R2", "id: R2\n    id: R3")])
def test_broken_rule_files_are_rejected(spark, folder, old, new):
    pytest.importorskip("yaml")
    with open(f"{folder}/rules.md", "w") as out:
        out.write(RULES.replace(old, new))
    with pytest.raises(ValueError):
        rulesets.read_rules(spark, folder)


def test_run_log_keeps_each_run_once(spark, folder):
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "run_id string, n int")
    writers.append_runs(runs, f"{folder}/log")
    writers.append_runs(runs.unionByName(spark.createDataFrame([("c", 3)], "run_id string, n int")), f"{folder}/log")
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{folder}/log").collect()) == ["a", "b", "c"]


def test_audit_keeps_earlier_runs(spark, folder):
    for run in ("r1", "r2"):
        writers.write_audit(spark.createDataFrame([(run, "PASS")], "run_id string, status string"), f"{folder}/audit")
    assert spark.read.json(f"{folder}/audit").count() == 2


def _deliver(spark, folder, name, rows):
    spark.createDataFrame(rows, "uid string, idx int, file string, digest string, arrived long").coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}")


def _ingest(spark, folder):
    stream = spark.readStream.schema("uid string, idx int, file string, digest string, arrived long").parquet(f"{folder}/in/*")
    keyed = stream.withColumn("key", W.attachment_key(*[F.col(c) for c in ("uid", "idx", "file", "digest")]))
    W.keep_new(keyed, f"{folder}/ledger", f"{folder}/cp").awaitTermination()
    return keyed.schema


def test_ingest_is_exactly_once_over_restarts(spark, folder):
    _deliver(spark, folder, "one", [("m1", 0, "a.pdf", "x", 1), ("m1", 0, "a.pdf", "x", 2), ("m1", 1, "a.pdf", "x", 3)])
    _ingest(spark, folder)
    # the same attachment again is nothing new, the same file in another message is
    _deliver(spark, folder, "two", [("m1", 0, "a.pdf", "x", 4), ("m2", 0, "a.pdf", "x", 5)])
    schema = _ingest(spark, folder)
    _ingest(spark, folder)
    rows = W.read_ledger(spark, f"{folder}/ledger", schema).collect()
    assert sorted((r["uid"], r["idx"], r["arrived"]) for r in rows) == [("m1", 0, 1), ("m1", 1, 3), ("m2", 0, 5)]


def test_latest_status_over_batches(spark, folder):
    schema = "doc_id string, updated_at long, status string"

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}")
        W.keep_latest(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/cp", compact_every=2).awaitTermination()
        return {r["doc_id"]: r["status"] for r in W.current_version(spark, f"{folder}/out", spark.createDataFrame([], schema).schema).collect()}
    assert run("one", [("a", 1, "x"), ("a", 3, "y"), ("b", 1, "x")]) == {"a": "y", "b": "x"}
    assert run("two", [("a", 2, "late"), ("b", 5, "z"), ("c", 1, "new")]) == {"a": "y", "b": "z", "c": "new"}
    # the third batch also writes a full version
    assert run("three", [("c", 2, "newer")]) == {"a": "y", "b": "z", "c": "newer"}
    assert run("four", [("a", 9, "last")]) == {"a": "last", "b": "z", "c": "newer"}


def test_checked_key_depends_on_the_query(value):
    a = value(lambda u: W.checked_key(u, "INBOX", "ALL", "x"), u="7")
    assert a != value(lambda u: W.checked_key(u, "INBOX", "ALL", "y"), u="7")


def test_summary_rows_reject_repeats_and_wrong_sums(spark):
    lines = spark.createDataFrame([("d", "A,1,2,3,6"), ("d", "B,1,2,3,7"), ("d", "C,1,0,0,1"), ("d", "C,1,0,0,1"), ("d", "합계,9,9,9,27")], "doc_id string, line string")
    assert {r["name"]: r["usable"] for r in S.summary_rows(lines, "doc_id", F.col("line")).collect()} == {"A": True, "B": False, "C": False}
