"""Expressions over distinct texts: each value is worked on once, and every row gets its own back."""

from pyspark.sql import functions as F

from attestra.operators import distinct, judgement as J
from attestra.operators.review import _shared, answers
from attestra.operators.rules import Rule
from attestra.session import widen


def test_every_text_is_worked_on_once_and_nulls_come_back(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "b"), (4, None, None), (5, "", "b"), (6, "a", "b"), (7, "a", "b")], "id int, x string, y string")
    seen = []

    def build(known):
        seen.append(known.count())
        return known.select("x", "y", F.concat_ws("|", F.coalesce("x", F.lit("-")), F.coalesce("y", F.lit("-"))).alias("v"))
    want = {1: "a|-", 2: "a|-", 3: "-|b", 4: "-|-", 5: "|b", 6: "a|b", 7: "a|b"}
    for bound in (100, 1):  # sent to every task, then met by a merge join
        monkeypatch.setattr(distinct, "SENT_TEXTS", bound)
        assert {r["id"]: r["v"] for r in distinct.once_per_text(rows, ["x", "y"], build).collect()} == want
    assert seen == [5, 5]


def test_judge_parses_a_pair_of_texts_once(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "10 mg 이하").otherwise("5 mg 이상").alias("criteria"), F.lit("7 mg").alias("result"))
    parsed, original = [], J.parse_records

    def counting(known):
        parsed.append(known.count())
        return original(known)
    monkeypatch.setattr(J, "parse_records", counting)
    assert {(r["status"], r["count"]) for r in J.judge(rows).groupBy("verdict.status").count().collect()} == {("PASS", 1000)}
    assert parsed == [2]


def test_a_file_of_one_row_group_is_spread_although_it_has_many_splits(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 8
        counts = [r["count"] for r in widen(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(counts) == 200_000 and max(counts) < 50_000


def test_stored_checks_are_columns_of_files(spark):
    checks = spark.range(10).select("id", F.lit(None).cast("string").alias("reason"), F.lit("PASS").alias("status"))
    rows, failed = answers({"A": checks}, checks.limit(0))
    assert failed == {} and rows[0].inputFiles() and sorted(map(tuple, rows[0].collect())) == [(i, None, "PASS") for i in range(10)]


def test_a_table_of_many_rules_is_stored_and_a_faulty_one_is_left(spark):
    rules = [Rule(f"S{i}", "signature") for i in range(3)] + [Rule("P", "process_order")]
    records = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("서명: 홍길동").alias("content"))
    tables = _shared({"records": records, "nodes": records}, rules)
    assert tables["records"].inputFiles() and tables["nodes"] is records
    assert sorted(r["doc_id"] for r in tables["records"].collect()) == [0, 1, 2]
    faulty = records.withColumn("content", F.raise_error(F.lit("unreadable")).cast("string"))
    assert _shared({"records": faulty}, rules)["records"] is faulty
