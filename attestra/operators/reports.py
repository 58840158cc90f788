"""Stage counts, run comparison, gold comparison and corpus reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import bp_sizes, fingerprint
from ..functions.core import contains_any, matches, sub
from ..functions.fields import numbers
from ..functions.text import key
from ..functions.verdict import is_above, is_below, required_below_count
from .ordered import running_last
from .permits import containing_pairs

COUNTS = ["pass", "fail", "hold", "total"]


def _counts(status: str = "status") -> list[Column]:
    return [F.count_if(F.col(status) == n).alias(n.lower()) for n in ("PASS", "FAIL", "HOLD")] + [F.count(F.lit(1)).alias("total")]


def stage_counts(evaluations: DataFrame, stages: DataFrame) -> DataFrame:
    """Counts per stage: the stage named in the section title, else by section number, else in the whole context.

    evaluations: doc_id, title, section_number, context, status; stages: doc_id, stage, number, position.
    Among equally good stages the first one is taken. Equal titles are matched once.
    """
    e = evaluations.groupBy("doc_id", key(F.col("title")).alias("tk"), "section_number", key(F.col("context")).alias("ck")).agg(*_counts())
    s = stages.withColumn("sk", key(F.col("stage")))
    names = s.groupBy("doc_id", "sk").agg(F.min(F.struct("position", "stage")).alias("s"))

    def inside(column: str, rank: int) -> DataFrame:
        pairs = containing_pairs(e.select("doc_id", column), names.select("doc_id", "sk"), "doc_id", column, "sk").where(F.col(column).contains(F.col("sk")))
        best = pairs.hint("merge").join(names, ["doc_id", "sk"]).groupBy("doc_id", column).agg(F.min("s").alias("s"))
        return best.select("doc_id", column, F.struct(F.lit(rank).alias("rank"), F.col("s.position"), F.col("s.stage")).alias(f"by_{column}"))
    top = F.split("section_number", r"\.")
    numbered = s.where("number is not null").groupBy("doc_id", F.col("number").alias("top")).agg(F.min(F.struct("position", "stage")).alias("s"))
    by_number = numbered.select("doc_id", "top", F.struct(F.lit(2).alias("rank"), F.col("s.position"), F.col("s.stage")).alias("by_number"))
    # as large as the evaluations, whatever the optimizer makes of their files
    joined = (e.withColumn("top", F.get(top, F.lit(0))).join(inside("tk", 1).hint("merge"), ["doc_id", "tk"], "left")
              .join(by_number.hint("merge"), ["doc_id", "top"], "left").join(inside("ck", 3).hint("merge"), ["doc_id", "ck"], "left"))
    chosen = F.coalesce("by_tk", "by_number", "by_ck")
    return joined.withColumn("stage", chosen["stage"]).groupBy("doc_id", "stage").agg(*[F.sum(m).alias(m) for m in COUNTS])


def stage_list(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Stages of a document: diagram names where there are any, else section titles; first position per folded name.

    nodes, titles: doc_id, name, position.
    """
    with_diagram = nodes.select("doc_id").distinct()
    plain = titles.join(with_diagram, "doc_id", "left_anti").withColumn("name", sub(F.col("name"), r"^\s*\d+(?:\.\d+)*\.?\s+", ""))
    rows = nodes.select("doc_id", "name", "position").unionByName(plain.select("doc_id", "name", "position"))
    return rows.groupBy("doc_id", key(F.col("name")).alias("k")).agg(F.min("position").alias("position"), F.min_by("name", "position").alias("stage")).where("k <> ''").drop("k")


def observations(evaluations: DataFrame, families: dict[str, list[str]], doc: str = "doc_id") -> DataFrame:
    """Counts per document and rule family (by wording of the source), and whether a reference was used."""
    family = F.lit(None).cast("string")
    for name, words in reversed(list(families.items())):
        family = F.when(contains_any(F.col("source"), words), name).otherwise(family)
    referred = matches(F.col("source"), r"(?i)permit|reference|허가|약전")
    rows = evaluations.withColumns({"family": F.coalesce(family, F.lit("other")), "referred": referred})
    return rows.groupBy(doc, "family").agg(*_counts(), F.bool_or("referred").alias("referred"))


def gold_comparison(observed: DataFrame, gold: DataFrame, doc: str = "doc_id") -> DataFrame:
    """match / mismatch / unset per document; unset gold cells do not count. Mismatching names are listed.

    observed, gold: doc, name, value. The names are the report's few columns.
    """
    wanted = gold.where("value is not null and trim(value) not in ('', '미설정')").select(doc, "name", F.col("value").alias("want"))
    joined = wanted.join(observed, [doc, "name"], "left")
    bad = F.coalesce(F.col("value") != F.col("want"), F.lit(True))
    rolled = joined.groupBy(doc).agg(F.count(F.lit(1)).alias("compared"), F.array_sort(F.collect_set(F.when(bad, F.col("name")))).alias("names"))
    out = observed.select(doc).distinct().join(rolled, doc, "left")
    status = F.when(F.col("compared").isNull(), "unset").when(F.size("names") > 0, "mismatch").otherwise("match")
    return out.select(doc, status.alias("status"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("names"))


def run_ids(runs: DataFrame, parts: list[str]) -> DataFrame:
    """Identity of a run: a digest of everything that can change its result."""
    return runs.withColumn("run_id", fingerprint(*[F.col(p) for p in parts]))


def new_runs(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Runs that history does not hold yet, one row per identity."""
    return runs.dropDuplicates(["run_id"]).join(history.select("run_id").distinct(), "run_id", "left_anti")


def corpus_assessment(findings: DataFrame, expected: DataFrame, clean_docs: DataFrame) -> DataFrame:
    """Expected failures that were not found, and failures found in documents that are known to be clean.

    findings: doc_id, rule_id, status; expected: doc_id, rule_id; clean_docs: doc_id.
    """
    failed = findings.where("status = 'FAIL'").select("doc_id", "rule_id").distinct()
    missing = expected.join(failed, ["doc_id", "rule_id"], "left_anti").select("doc_id", "rule_id", F.lit("missing").alias("kind"))
    surprising = failed.join(clean_docs, "doc_id", "left_semi").select("doc_id", "rule_id", F.lit("false_positive").alias("kind"))
    return missing.unionByName(surprising)


def run_equality(left: DataFrame, right: DataFrame, case: str) -> DataFrame:
    """Multiset equality of two runs per case; a case that only one run has is not equal."""
    value = [c for c in left.columns if c != case]
    # both runs are counted in one aggregation, so that equal rows meet without a join
    rows = [d.select(case, F.unhex(fingerprint(*[F.col(c) for c in value])).alias("id"), F.lit(n).alias("a"), F.lit(1 - n).alias("b")) for d, n in ((left, 1), (right, 0))]
    counted = rows[0].unionByName(rows[1]).groupBy(case, "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = counted.groupBy(case).agg(F.sum("a").alias("left_rows"), F.sum("b").alias("right_rows"), F.count_if(F.col("a") != F.col("b")).alias("different"))
    complete = (F.col("left_rows") > 0) & (F.col("right_rows") > 0)
    return sizes.select(case, complete.alias("complete"), (complete & (F.col("different") == 0)).alias("equal"), "different")


def part_equality(left: DataFrame, right: DataFrame, case: str, part: str) -> DataFrame:
    """Multiset equality of two runs per case and part, with the number of distinct rows that differ.

    Rows of both runs are counted by their fingerprint in one aggregation, and rows of unlike counts then per case and part; no rows
    are joined or read again. A part that only one run has is incomplete and not equal. A null case or part is one like any other.
    """
    value = [c for c in left.columns if c not in (case, part)]
    rows = [d.select(case, part, fingerprint(*[F.col(c) for c in value]).alias("id"), F.lit(first).alias("first")) for d, first in ((left, True), (right, False))]
    counted = rows[0].unionByName(rows[1]).groupBy(case, part, "id").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b"))
    out = counted.groupBy(case, part).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("a") != F.col("b")).alias("different"))
    return out.select(case, part, ((F.col("a") > 0) & (F.col("b") > 0)).alias("complete"), (F.col("different") == 0).alias("equal"), "different")


def corpus_report(docs: DataFrame, audits: DataFrame, engine: str) -> DataFrame:
    """One row per document; a missing, stale or inconsistent result can never be a success.

    audits: doc_id, engine, pass, fail, hold, total, holds_listed, missing_expectations.
    """
    joined = docs.select("doc_id").distinct().join(audits, "doc_id", "left")
    bad_sum = (F.least(*[F.col(c) for c in COUNTS]) < 0) | (F.col("pass") + F.col("fail") + F.col("hold") != F.col("total"))
    state = (F.when(F.col("engine").isNull(), "not_run").when(F.col("engine") != engine, "stale").when(F.coalesce(bad_sum, F.lit(True)), "inconsistent_counts")
             .when(F.col("hold") != F.col("holds_listed"), "hold_mismatch").when(F.col("missing_expectations") > 0, "expectation_missing")
             .when(F.col("hold") > 0, "holds_open").otherwise("complete"))
    return joined.select("doc_id", state.alias("state"))


def implementation_audit(catalogue: DataFrame) -> DataFrame:
    """Entries per implementation status, with repeated ids and unknown statuses counted."""
    known = ["implemented", "observed", "missing"]
    repeated = catalogue.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status"))
    return repeated.groupBy(F.when(F.col("status").isin(known), F.col("status")).otherwise("unknown").alias("status")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("n") > 1).alias("repeated_ids"))


# Wording of a rule and the job that carries it out.
EXECUTORS = [
    ("page_sequence", ["페이지번호"]), ("lots", ["제조번호"]), ("dates", ["제조년월일", "제조일", "분병일자", "포장일자"]),
    ("amounts", ["제조량", "사용량", "분량", "투입량"]), ("process", ["선후관계", "병렬공정", "합류"]),
    ("tests", ["시험기준", "시험결과", "수치기준", "범위기준"]), ("evidence", ["약전", "허가서", "참고문서", "검색근거", "근거"]),
]


def rule_catalogue(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rule bullets of a Markdown text with the heading above them and the job that carries them out.

    lines: keys, order, block, line.
    """
    title = F.when(F.col("line").startswith("#"), F.trim(sub(F.col("line"), r"^#+", "")))
    placed = running_last(lines, keys, "block", [order], title, "section").where(F.col("line").startswith("- "))
    flat = F.lower(sub(F.col("line"), r"\s+", ""))
    executor = F.lit("unmapped")
    for name, words in reversed(EXECUTORS):
        executor = F.when(contains_any(flat, words), name).otherwise(executor)
    return placed.select(*keys, order, "section", F.trim(F.substr("line", F.lit(3))).alias("rule"), executor.alias("executor"))


def declarative_rules(records: DataFrame, rules: list[dict]) -> DataFrame:
    """First decided rule per record. A rule matches when each '<field>_any' has a hit and each '<field>_all' is complete;

    it decides by 'text_pass' (wording in the result), 'terms_confirmed' (all terms in the result),
    'bp_contains_all' (all sizes present) or 'numeric_min_or_text' (a number at or above a minimum, else wording).
    """
    flat_result = key(F.col("result"))
    decided = F.lit(None).cast("struct<rule_id:string,status:string>")
    for rule in reversed(rules):
        here = F.lit(True)
        for name, terms in rule["match"].items():
            column, mode = name.rsplit("_", 1)
            hits = [key(F.col(column)).contains(key(F.lit(t))) for t in terms]
            combined = hits[0]
            for hit in hits[1:]:
                combined = (combined | hit) if mode == "any" else (combined & hit)
            here = here & combined
        words = contains_any(flat_result, rule.get("pass_terms", []))
        if rule["decide"] == "text_pass":
            status = F.when(words, "PASS")
        elif rule["decide"] == "terms_confirmed":
            every = F.lit(True)
            for term in rule["terms"]:
                every = every & flat_result.contains(term)
            status = F.when(every, "PASS").otherwise("FAIL")
        elif rule["decide"] == "bp_contains_all":
            need = F.array(*[F.lit(v).cast("long") for v in rule["sizes"]])
            status = F.when(F.size(F.array_except(need, bp_sizes(F.col("result")))) == 0, "PASS").otherwise("FAIL")
        else:
            top = F.array_max(numbers(F.col("result")))
            status = F.when(top.isNotNull(), F.when(top >= rule["minimum"], "PASS").otherwise("FAIL")).when(words, "PASS")
        answer = F.struct(F.lit(rule["id"]).alias("rule_id"), status.alias("status"))
        decided = F.when(here & status.isNotNull(), answer).otherwise(decided)
    return records.withColumn("decision", decided)


def rewrite_notation(records: DataFrame, aliases: list[dict]) -> DataFrame:
    """Unit spellings rewritten per test before judging, and a flag per field that shows what changed.

    Each alias: test (contained in the name), from, to. The original texts stay in place.
    """
    out = records
    for column in ("criteria", "result"):
        text = F.coalesce(F.col(column), F.lit(""))
        for a in aliases:
            pattern = r"(?i)(?<![A-Za-z/])" + re.escape(a["from"]).replace(r"\ ", r"\s+") + r"(?![A-Za-z/]|\s*/)"
            here = key(F.col("test_name")).contains(key(F.lit(a["test"])))
            text = F.when(here, sub(text, pattern, a["to"])).otherwise(text)
        out = out.withColumn(f"{column}_compared", text)
    return out.withColumn("rewritten", (F.col("criteria_compared") != F.coalesce("criteria", F.lit(""))) | (F.col("result_compared") != F.coalesce("result", F.lit(""))))


def table_below_count(rows: DataFrame, keys: list[str]) -> DataFrame:
    """At least k rows of a table below the quantification limit; undecided rows keep the table undecided.

    rows: keys, criteria, result (one row per table line).
    """
    rolled = rows.groupBy(*keys).agg(
        F.max(required_below_count(F.col("criteria"))).alias("needed"), F.count_if(is_below(F.col("result"))).alias("below"),
        F.count_if(is_above(F.col("result")) & ~is_below(F.col("result"))).alias("above"), F.count(F.lit(1)).alias("rows"))
    status = F.when(F.col("needed").isNull(), F.lit(None)).when(F.col("below") >= F.col("needed"), "PASS").when(F.col("below") + F.col("above") == F.col("rows"), "FAIL")
    return rolled.select(*keys, "needed", "below", status.alias("status"))
