"""Submissions: attachment classes, message relations, inbox status, version gate and link history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import contains_any, sub
from .ordered import block_of, neighbour

# File-name wording of a licence document.
PERMIT_TOKENS = ["허가서", "품목허가", "허가사항", "허가증", "permit", "authorization", "approval", "license"]


def subject_matches(subject: Column, keyword: str) -> Column:
    return F.lit(True) if not keyword.strip() else F.lower(subject).contains(keyword.strip().lower())


def attachment_type(name: Column) -> Column:
    flat = sub(F.lower(name), r"[\s_\-./()\[\]{}]+", "")
    return F.when(contains_any(flat, PERMIT_TOKENS), "permit").otherwise("sp")


def message_relations(attachments: DataFrame) -> DataFrame:
    """Type of every attachment and how many other documents and licences its message holds.

    When all of several attachments look like licences, the largest one is the document.
    attachments: message_id, file, size_bytes.
    """
    typed = attachments.withColumn("type", attachment_type(F.col("file")))
    groups = typed.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("type") == "permit").alias("all_permit"), F.max(F.struct("size_bytes", "file")).alias("largest"),
        F.count_if(F.col("type") == "sp").alias("sp"))
    joined = typed.join(groups, "message_id")
    promoted = F.col("all_permit") & (F.col("n") > 1)
    kind = F.when(promoted & (F.col("file") == F.col("largest.file")), "sp").otherwise(F.col("type"))
    sp = F.when(promoted, 1).otherwise(F.col("sp"))
    return joined.withColumn("type", kind).select(
        "message_id", "file", "type", (sp - F.when(F.col("type") == "sp", 1).otherwise(0)).alias("related_sp"),
        (F.col("n") - sp - F.when(F.col("type") == "permit", 1).otherwise(0)).alias("related_permits"))


def inbox_documents(submissions: DataFrame, since: str) -> DataFrame:
    """Documents (not licences) received on or after a date; without a received date the file time counts."""
    received = F.coalesce(F.try_to_date(F.substr("received_at", F.lit(1), F.lit(10))), F.to_date("file_time"))
    return submissions.where((received >= F.lit(since).cast("date")) & (F.coalesce("type", attachment_type(F.col("file"))) == "sp"))


FINGERPRINTS = ["cache_version", "rule_fingerprint", "extraction_fingerprint", "permit_fingerprint", "detail_fingerprint"]


def inbox_status(submissions: DataFrame, statuses: DataFrame) -> DataFrame:
    """pending / failed / completed per document: a status counts only with equal fingerprints, size and time.

    A result that holds everything is not a decision yet.
    """
    latest = statuses.groupBy("doc_id").agg(F.max(F.struct("updated_at", *FINGERPRINTS, "size", "mtime", "status", "pass", "fail", "hold", "total")).alias("s"))
    joined = submissions.join(latest, "doc_id", "left")
    same = F.lit(True)
    for name in [*FINGERPRINTS, "size", "mtime"]:
        same = same & (F.col(name) == F.col(f"s.{name}"))
    undecided = (F.col("s.total") > 0) & (F.col("s.hold") == F.col("s.total"))
    state = (F.when(~F.coalesce(same, F.lit(False)), "pending").when(F.col("s.status") == "failed", "failed")
             .when(F.col("s.total").isNull() | undecided, "pending").otherwise("completed"))
    return joined.select("doc_id", state.alias("state"), F.when(state == "completed", F.col("s.total")).alias("total"))


def references_for(docs: DataFrame, library: DataFrame) -> DataFrame:
    """Number of usable references per document: same company and product, else same product, else the library.

    docs: doc_id, company, product; library: company, product, ref_id.
    """
    exact = library.groupBy("company", "product").agg(F.count(F.lit(1)).alias("n_exact"), F.min("ref_id").alias("r_exact"))
    product = library.groupBy("product").agg(F.count(F.lit(1)).alias("n_product"), F.min("ref_id").alias("r_product"))
    joined = docs.join(exact, ["company", "product"], "left").join(product, "product", "left")
    rank = F.when(F.col("n_exact").isNotNull(), 1).when(F.col("n_product").isNotNull(), 2).otherwise(3)
    return joined.select("doc_id", rank.alias("rank"), F.coalesce("n_exact", "n_product").alias("references"), F.coalesce("r_exact", "r_product").alias("first_ref"))


def plain_version(version: Column) -> Column:
    return F.trim(sub(F.lower(F.trim(F.coalesce(version, F.lit("")))), r"^(?:ver\.?|version|v)\s*", ""))


def version_gate(docs: DataFrame, library: DataFrame, target: str) -> DataFrame:
    """ok / version_mismatch / version_unknown / product_unknown against the reference library."""
    known = library.select("company", "product").distinct().withColumn("known", F.lit(True))
    joined = docs.join(known, ["company", "product"], "left")
    v = plain_version(F.col("version"))
    gate = (F.when(F.col("known").isNull(), "product_unknown").when(v == "", "version_unknown").when(v == target, "ok").otherwise("version_mismatch"))
    return joined.select("doc_id", gate.alias("gate"))


def stale_results(statuses: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results whose input signature changed or whose input disappeared.

    statuses: doc_id, signature; inputs: doc_id, signature.
    """
    joined = statuses.join(inputs.withColumnRenamed("signature", "current"), "doc_id", "left")
    return joined.select("doc_id", (~F.equal_null("signature", "current")).alias("stale"))


def link_history(links: DataFrame) -> DataFrame:
    """Permit links with the time they were replaced; the open one has none.

    links: doc_id, linked_at (integer or time order), permit_id.
    """
    blocked = links.withColumn("block", block_of(F.col("linked_at")))
    return neighbour(blocked, ["doc_id"], "block", ["linked_at", "permit_id"], F.col("linked_at"), "replaced_at", following=True).drop("block")
