"""Records of a document from the spans that its headings, test names and tables open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import row_numbers, running_lasts

FIELDS = ["criteria", "result", "method", "test_period", "test_date", "remarks"]


def line_owners(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines with `section` (the open heading), `owner` (the innermost open heading or test) and `table`.

    A heading opens a section and closes the section and the test before it; a name line opens a test and closes the test
    before it; a run of lines with cells is a table of its owner and ends with it or with any other line. `table` names the run
    by the line before it and is null outside of tables. Lines before the first heading and name have no owner.
    """
    at = F.col(order).cast("long").alias("pos")
    head, name = F.col("heading").isNotNull(), F.coalesce(F.col("starts"), F.lit(False)) & F.col("heading").isNull()
    cells = F.col("line").contains("|") & ~head & ~name
    section = F.struct(at, F.col("heading.number").alias("number"), F.col("heading.title").alias("title"))
    owner = F.struct(at, F.when(head, "content").otherwise("test").alias("kind"), F.when(~head, F.col("line")).alias("name"), F.col("block").alias("block"))
    opened = {"section": F.when(head, section), "owner": F.when(head | name, owner), "_break": F.when(~cells, F.col(order))}
    return running_lasts(lines, keys, "block", [order], opened).withColumn("table", F.when(cells, F.coalesce("_break", F.lit(-1)))).drop("_break")


def _texts(field: str, value: str = "value") -> Column:
    values = F.array_sort(F.collect_list(F.when(F.col("what") == field, F.struct("at", value))))
    return F.nullif(F.array_join(F.transform(values, lambda v: v[value]), "\n"), F.lit(""))


def section_records(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Test and content records of all documents in reading order.

    A test has its name, per field the distinct values of its labelled lines, its tables behind the result, and the lines without a
    label as narrative; a name without any of them is no record. The lines under a heading that no test owns are the section's
    content, also those before the first heading (without a section). A content record ends with its block of lines and goes on in a
    further one (`part` 0, 1, ...), so no row holds more than a block. order_idx numbers the records of a document from 0.

    lines: keys, order, block, line, heading, kv, field and starts, as `lines.classify` and `lines.is_test_name` give them.
    """
    owned = cut_lineage(line_owners(lines, keys, order).select(
        *keys, F.col(order).alias("at"), "block", "line", "section", "owner", "table", F.col("field").alias("label"), F.col("kv.value").alias("written"),
        (F.col("heading").isNotNull() | F.coalesce(F.col("starts"), F.lit(False))).alias("opens")))
    body = owned.where(~F.col("opens")).withColumn("of", F.coalesce("owner.pos", F.lit(-1).cast("long")))
    in_test = F.coalesce(F.col("owner.kind") == "test", F.lit(False))
    tests = body.where(in_test)
    table = tests.where("table is not null").groupBy(*keys, "of", "table").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("value"))
    labelled = tests.where(F.col("table").isNull() & F.col("label").isin(FIELDS)).groupBy(*keys, "of", F.col("label").alias("what"), F.col("written").alias("value")).agg(F.min("at").alias("at"))
    plain = tests.where(F.col("table").isNull() & ~F.coalesce(F.col("label").isin(FIELDS), F.lit(False)))
    place = [*keys, "of", "what", "value", "at"]
    items = (labelled.select(*place).unionByName(table.withColumn("what", F.lit("table")).select(*place))
             .unionByName(plain.select(*keys, "of", F.lit("narrative").alias("what"), F.col("line").alias("value"), "at")))
    filled = items.groupBy(*keys, "of").agg(*[_texts(f).alias(f) for f in [*FIELDS, "narrative"]], _texts("table").alias("_tables"), F.count_if(F.col("what") == "table").alias("tables"))
    names = owned.where(F.col("opens") & (F.col("owner.kind") == "test") & (F.col("owner.pos") == F.col("at"))).select(
        *keys, F.col("at").cast("long").alias("of"), "section", F.col("owner.name").alias("test_name"), "block")
    result = F.nullif(F.concat_ws("\n", "result", "_tables"), F.lit(""))
    found = names.join(filled.withColumn("result", result).drop("_tables"), [*keys, "of"])
    test = found.select(*keys, F.col("of").alias("at"), "block", F.lit("test").alias("record_type"), "section", "test_name", *FIELDS, "narrative", "tables",
                        F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("part"))
    part = F.col("block") - F.coalesce("owner.block", F.lit(0))
    texts = F.array_sort(F.collect_list(F.struct("at", "line")))
    content = body.where(~in_test).groupBy(*keys, "of", part.alias("part")).agg(
        F.min("at").alias("at"), F.min("block").alias("block"), F.max("section").alias("section"), F.array_join(F.transform(texts, lambda x: x["line"]), "\n").alias("content"))
    empty = [F.lit(None).cast("string").alias(c) for c in ["test_name", *FIELDS, "narrative"]]
    content = content.select(*keys, F.col("at").cast("long").alias("at"), "block", F.lit("content").alias("record_type"), "section", *empty, F.lit(0).cast("long").alias("tables"), "content", "part")
    both = cut_lineage(test.unionByName(content))
    numbered = row_numbers(both, keys, "block", ["at"], "order_idx").withColumn("order_idx", F.col("order_idx") - 1)
    return numbered.select(*keys, "order_idx", "at", "record_type", F.col("section.number").alias("section_number"), F.col("section.title").alias("section_title"),
                           "test_name", *FIELDS, "narrative", "tables", "content", "part")
