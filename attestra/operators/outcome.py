"""Roll-up of checks into findings, dependency marks, guards and stage cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import literal_map
from ..functions.text import key
from .judgement import severity, severity_name


def outcome(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """One finding per document: any violation FAIL, else any gap HOLD, else nothing checked HOLD, else PASS."""
    rolled = checks.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "FAIL").alias("violations"), F.count_if(F.col("status") == "HOLD").alias("missing"),
        F.count_if(F.col("status").isin("PASS", "FAIL")).alias("checked"))
    joined = docs.select("doc_id").distinct().join(rolled, "doc_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("violations", "missing", "checked")}
    return joined.withColumns(zero).withColumn("status", _status())


def _status() -> Column:
    return (F.when(F.col("violations") > 0, "FAIL").when(F.col("missing") > 0, "HOLD")
            .when(F.col("checked") == 0, "HOLD").otherwise("PASS"))


def findings(docs: DataFrame, checks: DataFrame, rules: list) -> DataFrame:
    """Documents x rules, so that a document without any matching record still gets its HOLD; other products are N/A.

    `docs` may carry a product column; `checks` carries rule_id. The rule list is a small fixed dimension.
    """
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.array(*[key(F.lit(p)) for p in r.products]).cast("array<string>").alias("products"))
                     for r in rules])
    grid = docs.select("doc_id", "product", F.explode(rows).alias("r")).select(
        "doc_id", "r.rule_id", ((F.size("r.products") == 0) | F.array_contains("r.products", key(F.col("product")))).alias("applies"))
    rolled = checks.groupBy("doc_id", "rule_id").agg(
        F.count_if(F.col("status") == "FAIL").alias("violations"), F.count_if(F.col("status") == "HOLD").alias("missing"),
        F.count_if(F.col("status").isin("PASS", "FAIL")).alias("checked"))
    joined = grid.join(rolled, ["doc_id", "rule_id"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("violations", "missing", "checked")}
    return joined.withColumns(zero).withColumn("status", F.when(F.col("applies"), _status()).otherwise("N/A")).drop("applies")


def blocked_by(found: DataFrame, checks: DataFrame, rules: list) -> DataFrame:
    """A HOLD finding whose parent rule failed in the same document stays HOLD and names the parent.

    A dependency has a scope: it counts if the scope occurs in the reason of a gap or in the context that the rule selects.
    Rules and their dependencies are a small fixed dimension.
    """
    links = [(r.id, parent, scope or "", " ".join(r.selector.get("context", []))) for r in rules for parent, scope in r.depends_on.items()]
    if not links:
        return found.withColumn("blocked_by", F.lit(None).cast("array<string>"))
    table = F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("parent_id"), key(F.lit(c)).alias("scope"),
                               key(F.lit(d)).contains(key(F.lit(c))).alias("selected")) for a, b, c, d in links])
    held = found.where("status = 'HOLD'").select("doc_id", "rule_id", F.explode(F.filter(table, lambda d: d["rule_id"] == F.col("rule_id"))).alias("d"))
    parents = found.where("status = 'FAIL'").select("doc_id", F.col("rule_id").alias("parent_id"))
    open_ = held.select("doc_id", "rule_id", "d.parent_id", "d.scope", "d.selected").join(parents, ["doc_id", "parent_id"])
    gaps = checks.where("status = 'HOLD'").select("doc_id", "rule_id", key(F.col("reason")).alias("reason")).distinct()
    named = (open_.where("not selected").join(gaps, ["doc_id", "rule_id"]).where(F.col("reason").contains(F.col("scope")))
             .select("doc_id", "rule_id", "parent_id"))
    marks = open_.where("selected").select("doc_id", "rule_id", "parent_id").unionByName(named).groupBy("doc_id", "rule_id").agg(
        F.array_sort(F.collect_set("parent_id")).alias("blocked_by"))
    return found.join(marks, ["doc_id", "rule_id"], "left")


def guards(checks: DataFrame) -> DataFrame:
    """Failing record checks become guards of exactly those records."""
    return checks.where("status in ('FAIL', 'HOLD') and order_idx is not null").groupBy("doc_id", "order_idx").agg(
        severity_name(F.max(severity(F.col("status")))).alias("guard"))


def apply_guards(evaluations: DataFrame, guard_rows: DataFrame) -> DataFrame:
    """Guards only lower a verdict; the earlier verdict is kept beside the new one."""
    joined = evaluations.join(guard_rows, ["doc_id", "order_idx"], "left")
    lowered = severity_name(F.greatest(severity(F.col("status")), F.coalesce(severity(F.col("guard")), F.lit(0))))
    return joined.withColumns({"previous": F.col("status"), "status": lowered}).withColumn(
        "changed", F.col("previous") != F.col("status"))


def finding_rows(found: DataFrame, rules: list) -> DataFrame:
    """Findings as evaluation rows: N/A dropped, category from the alias letter."""
    category = literal_map({"A": "structure", "B": "numeric", "C": "time"})
    letter = F.try_element_at(literal_map({r.id: (r.params.get("alias") or "A")[:1] for r in rules}), F.col("rule_id"))
    return found.where("status <> 'N/A'").select("doc_id", F.col("rule_id").alias("test_name"), "status",
                                                 F.coalesce(F.try_element_at(category, letter), F.lit("structure")).alias("category"))


def stage_cards(checks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checks grouped by stage in diagram order; a stage the diagram does not know stays separate at the end."""
    first = nodes.groupBy("doc_id", "stage").agg(F.min("position").alias("position"))
    cards = checks.groupBy("doc_id", "stage").agg(
        severity_name(F.max(severity(F.col("status")))).alias("status"), F.count(F.lit(1)).alias("checks"))
    return cards.join(first, ["doc_id", "stage"], "left").withColumn("resolved", F.col("position").isNotNull())


def date_summary(docs: DataFrame, found: DataFrame, has_diagram: Column) -> DataFrame:
    """Worst of the date rules; no diagram page or no applicable rule is HOLD."""
    rolled = found.where("status <> 'N/A'").groupBy("doc_id").agg(F.max(severity(F.col("status"))).alias("level"))
    joined = docs.join(rolled, "doc_id", "left")
    return joined.withColumn("status", F.when(~has_diagram | F.col("level").isNull(), "HOLD").otherwise(severity_name(F.col("level")))).drop("level")


def shared_evidence(evidence: DataFrame) -> DataFrame:
    """Places (file, page, quote) that at least two failing rules cite."""
    groups = evidence.groupBy("file", "page", "quote").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return groups.where(F.size("rules") >= 2)
