"""Record parsing and judgement for a whole corpus, and the roll-ups of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, methods, verdict as V
from ..functions.core import blank_to_null
from ..functions.criterion import criterion
from ..functions.measure import measurement
from .distinct import once_per_text

SEVERITY_NAMES = ["PASS", "HOLD", "FAIL"]


def severity(status: Column) -> Column:
    return (F.when(status == "FAIL", 3).when(status == "HOLD", 2).when(status == "PASS", 1)).cast("int")


def severity_name(level: Column) -> Column:
    return F.when(level == 3, "FAIL").when(level == 2, "HOLD").when(level == 1, "PASS")


def parse_records(records: DataFrame) -> DataFrame:
    """Typed columns for criterion and result, computed once per record."""
    limit_like = F.col("result").rlike("[<>≤≥＜＞]|이하|미만|이상|초과")
    return records.withColumns({
        "crit": criterion(F.col("criteria")),
        "res": measurement(F.col("result")),
        "res_limit": F.when(limit_like, criterion(F.col("result"))),
    })


def cascade() -> Column:
    """First decided rule over parsed records; later rules are not evaluated once one decides."""
    c, r = F.col("criteria"), F.col("result")
    count = V.minimum_count(c, r)
    return F.coalesce(
        F.when(count["status"] != "PASS", count),
        V.stated(r),
        V.particle_volume(c, r),
        V.limit_expression(F.col("crit"), F.col("res_limit")),
        V.nearest_band(c, r),
        V.below_quantification(c, r),
        lexicon.confirmation(c, r),
        lexicon.semantic(c, r),
        V.several_requirements(c, r),
        V.numeric(F.col("crit"), F.col("res")),
    )


def judge_records(parsed: DataFrame) -> DataFrame:
    """Verdict and its source for every parsed record; whatever stays undecided is HOLD."""
    c, r = F.col("criteria"), F.col("result")
    routed = (
        F.when(V.requirement_echo(c, r).isNotNull(), V.requirement_echo(c, r))
        .when(blank_to_null(r).isNull(), V.verdict("HOLD", "routing", "result_missing"))
        .when(blank_to_null(c).isNull(), F.coalesce(V.stated(r), V.verdict("HOLD", "routing", "criterion_missing")))
        .otherwise(F.coalesce(cascade(), V.verdict("HOLD", "routing", "undecided")))
    )
    return parsed.withColumn("verdict", routed)


def judge(records: DataFrame) -> DataFrame:
    """`judge_records(parse_records(...))` without the parsed columns: every distinct pair of criterion and result is judged once."""
    return once_per_text(records, ["criteria", "result"], lambda known: judge_records(parse_records(known)).select("criteria", "result", "verdict"))


def apply_methods(judged: DataFrame) -> DataFrame:
    """A general-method verdict replaces the earlier one unless that came from an echo or the permit authority."""
    text = F.concat_ws("\n", "test_name", "method", "criteria", "result", "test_period")
    dated = F.concat_ws("\n", *[blank_to_null(F.col(c)) for c in ("test_period", "test_date", "raw_text") if c in judged.columns])
    decided = methods.method_verdict(text, F.col("result"), F.col("criteria"), dated)
    fixed = F.col("verdict.comparator").isin("echo", "permit_authority")
    return (judged.withColumn("method_verdict", decided)
            .withColumn("source", F.when(~fixed & F.col("method_verdict").isNotNull(), "method").otherwise("cascade"))
            .withColumn("verdict", F.when(F.col("source") == "method", F.col("method_verdict")).otherwise(F.col("verdict"))))


def worst_of(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Any FAIL fails, else any HOLD holds, else PASS; partial aggregation keeps hot keys small."""
    level = F.max(severity(F.col(status)))
    return rows.groupBy(*keys).agg(severity_name(level).alias("status"), F.count(F.lit(1)).alias("rows"))


def status_counts(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """PASS/FAIL/HOLD counts per key with a totals row (all keys null), in one pass over the rows."""
    grouped = rows.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys])
    return grouped.agg(*[
        F.count_if(F.col(status) == name).alias(name.lower()) for name in ("PASS", "FAIL", "HOLD")
    ], F.count(F.lit(1)).alias("total"))


def record_or_lot_counts(evaluations: DataFrame, lots: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A record with lot rows counts its rows instead of itself."""
    keys = [doc, "order_idx"]
    alone = evaluations.join(lots.select(*keys).distinct(), keys, "left_anti").select(doc, "status")
    return status_counts(lots.select(doc, "status").unionByName(alone), [doc])


def remainder(totals: DataFrame, stages: DataFrame, key: str) -> DataFrame:
    """Document totals minus stage totals; a negative or inconsistent remainder is flagged."""
    measures = ["pass", "fail", "hold", "total"]
    staged = stages.groupBy(key).agg(*[F.sum(m).alias(f"s_{m}") for m in measures])
    left = totals.join(staged, key, "left")
    rest = {m: F.col(m) - F.coalesce(F.col(f"s_{m}"), F.lit(0)) for m in measures}
    out = left.select(key, *[expr.alias(m) for m, expr in rest.items()])
    negative = F.least(*[F.col(m) for m in measures]) < 0
    return out.withColumn("consistent", ~negative & (F.col("pass") + F.col("fail") + F.col("hold") == F.col("total")))


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Signed change of the counts between two passes; a stage of one pass only keeps its row."""
    measures = ["pass", "fail", "hold", "total"]
    b = before.select(key, *[F.col(m).alias(f"b_{m}") for m in measures])
    a = after.select(key, *[F.col(m).alias(f"a_{m}") for m in measures])
    joined = b.join(a, key, "full_outer")
    return joined.select(key, *[
        (F.coalesce(F.col(f"a_{m}"), F.lit(0)) - F.coalesce(F.col(f"b_{m}"), F.lit(0))).alias(f"d_{m}") for m in measures
    ])
