"""Rule sets: small Markdown files with YAML front matter become a validated dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key
from ..operators.parameters import rule_problems
from ..operators.rules import OPERATIONS, Rule
from ..session import DIMENSION_ROW_LIMIT

_ALLOWED = {"id", "operation", "selector", "params", "products", "depends_on", "criterion_source", "title", "instruction", "aliases"}


def unique_keys(yaml):
    """A safe loader that refuses a mapping with a key written twice."""
    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            names = [key.value for key, _ in node.value]
            if len({str(n) for n in names}) < len(names):
                raise ValueError(f"a key is written twice at line {node.start_mark.line + 1}")
            return super().construct_mapping(node, deep)
    return Loader


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of all files under a folder.

    Unknown keys and operations, keys written twice, and selectors or parameters that do not fit the operation are rejected before any job runs.
    """
    import yaml
    files = spark.read.text(path, wholetext=True).limit(DIMENSION_ROW_LIMIT + 1).collect()
    if len(files) > DIMENSION_ROW_LIMIT:
        raise ValueError("a rule set is configuration; this folder is not one")
    rules: list[Rule] = []
    for row in files:
        if not row.value.startswith("---\n"):
            continue
        for entry in (yaml.load(row.value.split("---", 2)[1], unique_keys(yaml)) or {}).get("rules", []):
            extra = set(entry) - _ALLOWED
            if extra:
                raise ValueError(f"unknown keys {sorted(extra)} in rule {entry.get('id')}")
            if entry["operation"] not in OPERATIONS:
                raise ValueError(f"unknown operation {entry['operation']} in rule {entry['id']}")
            if problems := rule_problems(entry["operation"], entry.get("selector") or {}, entry.get("params") or {}):
                raise ValueError(f"rule {entry['id']} ({entry['operation']}): {'; '.join(problems)}")
            rules.append(Rule(entry["id"], entry["operation"], entry.get("selector") or {}, entry.get("params") or {},
                              tuple(entry.get("products", ())), entry.get("depends_on", {}), entry.get("criterion_source", "sp")))
    ids = [r.id for r in rules]
    if not ids or len(ids) != len(set(ids)):
        raise ValueError("rule ids must exist and be unique")
    for r in rules:
        if r.id in r.depends_on or set(r.depends_on) - set(ids):
            raise ValueError(f"invalid dependency of rule {r.id}")
    return rules


def rule_errors(rules: DataFrame, requirements: DataFrame) -> DataFrame:
    """Integrity of a rule table: repeated ids, unknown operations, dependencies and requirements.

    rules: book, rule_id, operation, parent_id (nullable), requirement_id (nullable); requirements: book, requirement_id.
    """
    repeated = rules.groupBy("book", "rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("book", "rule_id", F.lit("repeated_id").alias("error"))
    unknown = rules.where(~F.col("operation").isin(sorted(OPERATIONS))).select("book", "rule_id", F.lit("unknown_operation").alias("error"))
    ids = rules.select("book", F.col("rule_id").alias("parent_id")).distinct()
    parents = rules.where("parent_id is not null")
    orphan = parents.join(ids, ["book", "parent_id"], "left_anti").select("book", "rule_id", F.lit("unknown_dependency").alias("error"))
    own = parents.where("parent_id = rule_id").select("book", "rule_id", F.lit("self_dependency").alias("error"))
    unbound = rules.where("requirement_id is not null").join(requirements, ["book", "requirement_id"], "left_anti").select(
        "book", "rule_id", F.lit("unknown_requirement").alias("error"))
    return repeated.unionByName(unknown).unionByName(orphan).unionByName(own).unionByName(unbound).distinct()


def overlapping_aliases(aliases: DataFrame) -> DataFrame:
    """Scoped spellings that two entries claim. aliases: book, product, test, criteria, value."""
    folded = [key(F.col(c)).alias(c) for c in ("product", "test", "criteria", "value")]
    return aliases.select("book", *folded).groupBy("book", "product", "test", "criteria", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
