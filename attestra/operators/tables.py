"""Tables written inside text: pipe rows, lot tables, transposition and expansion into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import contains_any, let, matches
from ..functions.text import clean
from .ordered import block_of, running_sum

# Header wording of the columns that make a table a test table, and of its lot/result/date columns.
TEST_HEADERS = ["시험항목", "시험명", "항목"]
RESULT_HEADERS = ["시험결과", "실험결과", "측정결과", "결과"]
DATE_HEADERS = ["시험일", "시험일자", "시험기간", "시험년월"]
LOT_HEADERS = ["로트", "제조번호", "배치"]


def pipe_cells(line: Column) -> Column:
    """Trimmed cells of one '|' line without the outer border cells."""
    return F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))


def pipe_rows(text: Column) -> Column:
    """array of rows (arrays of cells); the first row is the header.

    A row with fewer cells than the header waits for the next line, whose first cell continues its last one.
    """
    lines = F.filter(F.transform(F.split(clean(text), "\n"), lambda x: F.trim(x)),
                     lambda x: x.contains("|") & ~matches(x, r"^[※*]") & ~matches(x, r"^[|:\-\s]+$"))
    rows = F.transform(lines, pipe_cells)

    def fold(all_rows: Column) -> Column:
        header = F.get(all_rows, F.lit(0))
        width = F.size(header)
        start = F.struct(F.array(header).alias("done"), F.array().cast("array<string>").alias("open"))

        def pad(row: Column) -> Column:
            return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), width)

        def step(state: Column, row: Column) -> Column:
            waiting = F.size(state["open"]) > 0
            glued = F.concat(F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0))),
                             F.array(F.trim(F.concat_ws(" ", F.try_element_at(state["open"], F.lit(-1)), F.get(row, F.lit(0))))),
                             F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))))
            now = F.when(waiting, glued).otherwise(row)
            return let(now, lambda r: F.when(F.size(r) >= width, F.struct(
                F.array_append(state["done"], F.slice(r, F.lit(1), width)).alias("done"), F.array().cast("array<string>").alias("open")))
                .otherwise(F.struct(state["done"].alias("done"), r.alias("open"))))

        def close(state: Column) -> Column:
            return F.when(F.size(state["open"]) > 0, F.array_append(state["done"], pad(state["open"]))).otherwise(state["done"])
        return F.when((F.size(all_rows) > 1) & (width >= 2), F.aggregate(
            F.slice(all_rows, F.lit(2), F.greatest(F.size(all_rows) - 1, F.lit(1))), start, step, close))
    return let(rows, fold)


def table_cells(tables: DataFrame, keys: list[str], rows: str = "rows") -> DataFrame:
    """Long form of parsed tables: one row per body cell with its header."""
    # the header is taken before the rows are made: taken beside them, every row would carry its whole table
    headed = tables.select(*keys, rows, F.get(rows, F.lit(0)).alias("header"))
    body = headed.select(*keys, "header", F.posexplode(rows).alias("row_no", "cells")).where("row_no > 0")
    cells = body.select(*keys, "row_no", "header", F.posexplode("cells").alias("col_no", "cell"))
    return cells.select(*keys, "row_no", "col_no", F.get("header", F.col("col_no")).alias("header"), "cell")


def header_role(header: Column) -> Column:
    flat = F.regexp_replace(header, r"\s+", "")
    return (F.when(contains_any(flat, RESULT_HEADERS), "result").when(contains_any(flat, DATE_HEADERS), "date")
            .when(contains_any(flat, LOT_HEADERS), "lot").when(contains_any(flat, TEST_HEADERS), "test"))


def table_kind(cells: DataFrame, keys: list[str]) -> DataFrame:
    """multi_test when a table names tests and results in its headers (or in its first column), else supporting."""
    role = header_role(F.col("header"))
    side = F.when(F.col("col_no") == 0, header_role(F.col("cell")))
    flags = cells.groupBy(*keys).agg(
        F.bool_or(role == "test").alias("t"), F.bool_or(role == "result").alias("r"),
        F.bool_or(F.coalesce(side == "test", F.lit(False))).alias("st"), F.bool_or(F.coalesce(side == "result", F.lit(False))).alias("sr"))
    yes = {c: F.coalesce(c, F.lit(False)) for c in ("t", "r", "st", "sr")}
    kind = F.when(yes["t"] & yes["r"], "multi_test").when(yes["st"] & yes["sr"], "transposed").otherwise("supporting")
    return flags.select(*keys, kind.alias("kind"))


def lot_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Lot, date and result of each body row by header wording; rows without a result are dropped."""
    typed = cells.withColumn("role", header_role(F.col("header")))
    rows = typed.groupBy(*keys, "row_no").agg(*[
        F.min(F.when(F.col("role") == r, F.struct("col_no", "cell"))).alias(r) for r in ("lot", "date", "result")])
    return rows.select(*keys, "row_no", F.col("lot.cell").alias("item_value"), F.col("date.cell").alias("test_date"),
                       F.col("result.cell").alias("result")).where("result is not null and result <> ''")


def horizontal_lots(text: Column) -> Column:
    """array<struct(lot, result, date)> of a table whose rows are lots, dates and results."""
    rows = F.transform(F.filter(F.split(clean(text), "\n"), lambda x: x.contains("|")), pipe_cells)

    def read(all_rows: Column) -> Column:
        def row_of(words: list[str]) -> Column:
            hit = F.filter(all_rows, lambda r: contains_any(F.get(r, F.lit(0)), words))
            return F.flatten(F.transform(hit, lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))))
        return let(row_of(["로트"]), lambda lots: let(row_of(RESULT_HEADERS[:3]), lambda res: let(row_of(DATE_HEADERS), lambda days: F.when(
            (F.size(lots) > 0) & (F.size(res) > 0), F.transform(lots, lambda v, i: F.struct(
                v.alias("lot"), F.get(res, i).alias("result"), F.get(days, i).alias("date")))))))
    return let(rows, read)


def transpose(cells: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """A table with one label per row becomes one record per column."""
    names = cells.where("col_no = 0").select(*keys, "row_no", F.col("cell").alias("label"))
    values = cells.where("col_no > 0").join(names, [*keys, "row_no"])
    return values.groupBy(*keys, "col_no").pivot("label", labels).agg(F.min("cell"))


def expand_tests(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One test record per row of a multi-test table; an implausible row turns the whole table into a warning.

    The record order is the table's order plus row/10000; a missing criterion is inherited.
    """
    typed = cells.withColumn("role", header_role(F.col("header")))
    rows = typed.groupBy(*keys, "row_no").agg(*[
        F.min(F.when(F.col("role") == r, F.struct("col_no", "cell"))).alias(r) for r in ("test", "result")],
        F.min(F.when(F.col("header").contains("기준"), F.struct("col_no", "cell"))).alias("crit"))
    rows = rows.select(*keys, "row_no", F.col("test.cell").alias("test_name"), F.col("result.cell").alias("result"), F.col("crit.cell").alias("row_criteria"))
    bad = (F.coalesce("test_name", F.lit("")) == "") | matches(F.coalesce("test_name", F.lit("")), r"^[\d.,\s%~\-]+$")
    broken = rows.groupBy(*keys).agg(F.bool_or(bad).alias("warning"))
    joined = rows.join(broken, keys).join(tables.select(*keys, "order_idx", "criteria"), keys)
    criteria = F.coalesce(F.nullif("row_criteria", F.lit("")), F.nullif("criteria", F.lit("")))
    return joined.select(*keys, (F.col("order_idx") + F.col("row_no") / 10000).alias("order_idx"), "test_name", "result",
                         criteria.alias("criteria"), criteria.isNull().alias("needs_permit"), "warning")


def agreed_value(cells: DataFrame, keys: list[str], role: str) -> DataFrame:
    """The single value a column agrees on; several different values give null."""
    chosen = cells.where(header_role(F.col("header")) == role).where("cell <> ''")
    return chosen.groupBy(*keys).agg(F.when(F.min("cell") == F.max("cell"), F.min("cell")).alias("value"), F.count(F.lit(1)).alias("rows"))


def month_rows(text: Column) -> Column:
    """array<struct(lot, date, result)> of white-space rows that carry a month: 'LOT 2024.05 result'."""
    pattern = r"^(\S+)\s+(20\d{2}[.\-/]\d{1,2}(?:[.\-/]\d{1,2})?)\s+(.+)$"
    lines = F.filter(F.split(clean(text), "\n"), lambda x: matches(x, pattern))
    return F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, "(?U)" + pattern, 1).alias("lot"), F.regexp_extract(x, "(?U)" + pattern, 2).alias("date"),
        F.regexp_extract(x, "(?U)" + pattern, 3).alias("result")))


def merge_split_rows(rows: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """Material rows continued on the next page become one row; headers repeated there disappear.

    A row continues the one above when its first cell and its amount (the last column) are empty; text cells are
    joined with a blank, the lot (second to last column) without one. rows: doc, position and the columns.
    """
    first, lot, amount = columns[0], columns[-2], columns[-1]
    header = F.lit(True)
    for c in columns:
        header = header & (F.trim(c) == c)
    body = rows.where(~header).withColumn("block", block_of(F.col("position")))
    blank = {c: F.coalesce(F.trim(c), F.lit("")) == "" for c in columns}
    continued = blank[first] & blank[amount] & ~(blank[columns[1]] & blank[lot])
    opened = running_sum(body, [doc], "block", ["position"], F.when(continued, 0).otherwise(1), "row_no")
    cells = {c: F.array_sort(F.collect_list(F.when(~blank[c], F.struct("position", F.trim(c).alias("v"))))) for c in columns}
    return opened.where("row_no > 0").groupBy(doc, "row_no").agg(*[
        F.array_join(F.transform(cells[c], lambda x: x["v"]), "" if c == lot else " ").alias(c) for c in columns])
