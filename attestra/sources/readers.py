"""Readers: submissions, pages, records, knowledge and summaries. Schemas are explicit everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators.lines import pack_paragraphs

MAX_BYTES = 100 * 1024 * 1024
MAX_FILES = 30

RECORD_FIELDS = ("record_type string, section_number string, section_title string, test_name string, criteria string, result string, "
                 "method string, test_date string, test_period string, remarks string, page_start int, page_end int, order_idx double")
SUMMARY_FIELDS = "name string, pass long, fail long, hold long, total long"
# Names of a totals row.
TOTAL_MARKS = ["합계", "총계", "전체", "total"]


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as rows (path, length, content, modificationTime), without decoding them."""
    return spark.read.format("binaryFile").load(path)


def accept_submissions(files: DataFrame, batch: str) -> DataFrame:
    """Accepted files with their digest: non-empty, at most 100 MB, PDF signature, and at most 30 files in their batch."""
    sizes = files.groupBy(batch).agg(F.count(F.lit(1)).alias("batch_files"))
    head = F.substr(F.col("content"), F.lit(1), F.lit(5))
    ok = F.col("length").between(1, MAX_BYTES) & (head == F.lit("%PDF-").cast("binary")) & (F.col("batch_files") <= MAX_FILES)
    return files.join(sizes, batch).withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn(
        "sha256", F.when(F.col("accepted"), F.sha2("content", 256)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, doc_kind string, page_no int, text string").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per document, each a list of record objects."""
    texts = spark.read.text(path, wholetext=True).withColumn("doc_id", F.input_file_name())
    return records_from_json(texts, "doc_id", F.col("value"))


def records_from_json(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """Typed records of a JSON list; entries that are not objects are dropped, a missing order is the position."""
    items = F.from_json(text, "array<string>")
    rows = df.select(doc, F.posexplode(items).alias("position", "item")).where(F.trim("item").startswith("{"))
    parsed = rows.select(doc, "position", F.from_json("item", RECORD_FIELDS, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null")
    return parsed.select(doc, F.coalesce("r.order_idx", F.col("position").cast("double")).alias("order_idx"), *[
        F.col(f"r.{f.split()[0]}") for f in RECORD_FIELDS.split(", ") if not f.startswith("order_idx")])


def knowledge(sources: list[DataFrame], minimum: int = 20) -> DataFrame:
    """One passage table from several sources: the first source wins per key; permits and short passages are dropped.

    Each source: doc_key, text, domain, source. The order of the list is the priority.
    """
    ranked = [s.select("doc_key", F.struct(F.lit(i).alias("rank"), clean(F.col("text")).alias("text"), "domain", "source").alias("r")) for i, s in enumerate(sources)]
    union = ranked[0]
    for more in ranked[1:]:
        union = union.unionByName(more)
    first = union.groupBy("doc_key").agg(F.min("r").alias("r")).select("doc_key", "r.text", "r.domain", "r.source")
    return first.where((F.length("text") >= minimum) & (F.col("domain") != "permit"))


def page_chunks(pages: DataFrame, key: str, limit: int = 2600) -> DataFrame:
    """Passages of at most `limit` characters with their number."""
    return pages.select(key, F.posexplode(pack_paragraphs(F.col("text"), limit)).alias("chunk_no", "text"))


def summary_rows(lines: DataFrame, doc: str, text: Column) -> DataFrame:
    """Counts by position (name, pass, fail, hold, total); the totals row is left out, and each row says whether it is usable."""
    rows = lines.select(doc, F.from_csv(text, SUMMARY_FIELDS).alias("r")).select(doc, "r.*")
    rows = rows.where(F.col("name").isNotNull() & ~F.lower(F.trim("name")).isin(TOTAL_MARKS))
    names = rows.groupBy(doc, F.trim("name").alias("name")).agg(
        F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("pass", "fail", "hold", "total")])
    balanced = F.coalesce(F.col("pass") + F.col("fail") + F.col("hold") == F.col("total"), F.lit(False))
    return names.withColumn("usable", balanced & (F.col("times") == 1)).drop("times")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path).withColumn("doc_id", F.input_file_name())
    return summary_rows(texts, "doc_id", F.col("value"))
