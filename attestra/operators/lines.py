"""From page text to classified lines, sections, paths and test records.

`position` orders the lines of a document; `block` groups neighbouring positions, so that a document
of any length is processed in many tasks (see `ordered`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.core import MARK, free_of_mark, let, literal_map, matches, sub, with_mark
from ..functions.fields import key_value
from ..session import cut_lineage
from .ordered import block_of, neighbour, row_numbers, running_last, running_lasts, running_sum

# Field labels of a test block and the field each one fills.
LABELS = {
    "시험기준": "criteria", "기준": "criteria", "규격": "criteria", "품질기준": "criteria", "허용기준": "criteria",
    "시험결과": "result", "결과": "result", "측정결과": "result", "실험결과": "result",
    "시험방법": "method", "분석방법": "method", "시험법": "method", "분석법": "method",
    "시험일자": "test_date", "시험일": "test_date", "시험기간": "test_period",
    "비고": "remarks", "참고": "remarks", "특이사항": "remarks", "시험명": "test_name", "시험항목": "test_name",
}
# Spellings with inner spaces and their canonical label.
SPACED_LABELS = {
    "시험 기준": "시험기준", "시험 결과": "시험결과", "시험 방법": "시험방법", "시험 항목": "시험항목", "시험 명": "시험명",
    "기 준": "기준", "결 과": "결과", "규 격": "규격", "비 고": "비고", "참 고": "참고", "특이 사항": "특이사항",
    "측정 결과": "측정결과", "실험 결과": "실험결과", "분석 방법": "분석방법", "시험 법": "시험법", "분석 법": "분석법",
    "품질 기준": "품질기준", "허용 기준": "허용기준", "시험 일자": "시험일자", "시험 날짜": "시험일자", "시험 기간": "시험기간",
    "시험 일": "시험일",
}
# Endings that complete a test name broken over two lines.
NAME_ENDINGS = ["시험", "검사", "분석", "측정", "확인시험", "부정시험", "함량시험", "측정시험", "분석시험", "정량시험",
                "불활화시험", "안정성시험", "검출시험", "크로마토그래피시험", "분포시험", "균일성시험", "이물시험", "미립자시험"]
# Wording of a test name, and of lines that only look like one.
_NAME = r"(?:.+(?:시험|검사|분석|측정)(?:\([^)]*\))?|성상|엔도톡신|(?i:ph)측정)$"
_NOT_A_NAME = (r"^(?:시험|기준|결과|방법|비고|참고|정보|피크|하고|하며|함)$"
               r"|^(?:시험기준|시험결과|시험방법|시험기간|시험일|시험자|시험책임자|제품명|품목명|제조번호|제조일|유효기간"
               r"|확인/서명|양성대조군|저장방법|충진량|분병일자|승인된\s*방법|이하이어야|이상이어야|하여야)"
               r"|^\d+(?:\.\d+)*\s*시험$|페이지|(?:바이알|상자|mL|ml|mg|kg|접종량)|[:：|]")


# Pieces of a text whose offsets are summed together; even, since every other piece is a hit.
CUE_PIECES = 64


def explode_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line with its position inside the row's text and the block it falls into."""
    lines = pages.select(*keys, F.posexplode(F.split(F.translate(text, "\r", "\n"), "\n")).alias("line_no", "raw"))
    return lines.withColumn("block", block_of(F.col("line_no")))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks, page furniture, leader lines and reviewer comments."""
    def kept(line: Column) -> Column:
        return F.when(~(T.is_page_furniture(line) | T.is_leader(line) | T.is_reviewer_comment(line)), T.strip_leaders(line))
    # made inside a generator: the optimizer would copy the clean-up into every condition on the line
    line = F.filter(F.array(let(T.clean(F.col("raw")), kept)), lambda x: x != "")
    return lines.select(*[c for c in lines.columns if c != "line"], F.explode(line).alias("line"))


def canonical_label(label: Column) -> Column:
    """Spaced spellings and trailing colons removed; an unknown label stays as written."""
    trimmed = sub(T.join_decimals(T.clean(label)), r"\s*[:：]\s*$", "")
    return F.when(label.isNotNull(), let(trimmed, lambda v: F.coalesce(F.try_element_at(literal_map(SPACED_LABELS), v), v)))


def label_field(label: Column) -> Column:
    return F.try_element_at(literal_map(LABELS), canonical_label(label))


def is_test_name(line: Column) -> Column:
    return (F.length(line) <= 150) & matches(line, "^" + _NAME) & ~matches(line, _NOT_A_NAME)


def join_broken_names(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A line completed by a following bare ending takes it over; the ending line disappears.

    In a run of consecutive candidates only every second one starts a join, because the line that was
    taken over cannot start another. Only the few candidate lines take part in that bookkeeping.
    """
    ahead = neighbour(lines, keys, "block", [order], F.struct(F.col("line").alias("line"), F.col(order).alias("pos")), "_next", following=True)
    joined = F.concat("line", F.col("_next.line"))
    found = ahead.where(F.col("_next.line").isin(NAME_ENDINGS) & is_test_name(joined))
    candidates = cut_lineage(found.select(*keys, "block", order, F.col("_next.pos").alias("_end"), joined.alias("_joined")))
    follows = candidates.select(*keys, F.col("_end").alias(order), F.lit(True).alias("_follows"))
    numbered = row_numbers(candidates.join(follows, [*keys, order], "left"), keys, "block", [order], "_n")
    runs = running_last(numbered, keys, "block", [order], F.when(F.col("_follows").isNull(), F.col("_n")), "_first")
    starts = runs.where((F.col("_n") - F.col("_first")) % 2 == 0)
    taken = starts.select(*keys, F.col("_end").alias(order))
    kept = lines.join(taken, [*keys, order], "left_anti").join(starts.select(*keys, order, "_joined"), [*keys, order], "left")
    return kept.withColumn("line", F.coalesce("_joined", "line")).drop("_joined")


def classify(lines: DataFrame) -> DataFrame:
    """Heading struct, key/value struct and the field a label fills."""
    names = sorted(set(LABELS) | set(SPACED_LABELS), key=len, reverse=True)
    rows = lines.withColumn("heading", T.heading(F.col("line")))
    rows = rows.withColumn("kv", F.when(F.col("heading").isNull(), key_value(F.col("line"), names, ["양성대조군"])))
    return rows.withColumn("field", label_field(F.col("kv.key")))


def sections(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every line carries the heading it belongs to; lines before the first heading carry null."""
    return running_last(lines, keys, "block", order, F.col("heading"), "section")


def section_paths(lines: DataFrame, keys: list[str], order: str, levels: int | None = None) -> DataFrame:
    """Stack of open headings at each line: array of struct(pos, number, title, depth).

    A heading of depth k is open while no heading of depth <= k has followed it. Without `levels` the deepest heading of the
    lines decides, which is one aggregate; with it, deeper headings are no part of any path.
    """
    if levels is None:
        levels = lines.agg(F.max("heading.depth")).first()[0] or 0
    entry = F.struct(F.col(order).alias("pos"), F.col("heading.number").alias("number"), F.col("heading.title").alias("title"),
                     F.col("heading.depth").alias("depth"))
    open_at = {f"_d{k}": F.when(F.col("heading.depth") <= k, entry) for k in range(1, levels + 1)}
    rows = running_lasts(lines, keys, "block", [order], open_at) if levels else lines
    stack = [F.when(F.col(f"_d{k}.depth") == k, F.col(f"_d{k}")) for k in range(1, levels + 1)]
    path = F.array_compact(F.array(*stack)) if stack else F.array()
    return rows.withColumn("path", path).drop(*[f"_d{k}" for k in range(1, levels + 1)])


def descendants(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Membership rows (ancestor position, chunk): a chunk belongs to itself and to every open ancestor."""
    return chunks.select(*keys, F.explode(F.transform("path", lambda p: p["pos"])).alias("ancestor"), "position", "text")


def assemble_records(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Test records: a name line opens a record, the lines up to the next name fill it.

    Labelled lines fill criteria, result, method, test_period, test_date and remarks, lines without a label the narrative.
    Several distinct values of one field are kept in order, joined by a line break.
    """
    opened = running_sum(lines, keys, "block", [order], F.when(F.col("starts"), 1).otherwise(0), "record_no")
    name = F.when(F.col("starts"), F.col("line"))
    field = F.coalesce("field", F.when(~F.coalesce("starts", F.lit(False)) & F.col("kv").isNull() & F.col("heading").isNull(), "narrative"))
    value = F.when(F.col("field").isNotNull(), F.col("kv.value")).otherwise(F.col("line"))
    first = opened.groupBy(*keys, "record_no", field.alias("field"), value.alias("value")).agg(
        F.min(order).alias("pos"), F.max(name).alias("test_name"), F.min(order).alias("first_pos"))
    fields = ["criteria", "result", "method", "test_period", "test_date", "remarks", "narrative"]
    return first.where("record_no > 0").groupBy(*keys, "record_no").agg(
        F.max("test_name").alias("test_name"), F.min("first_pos").alias("order_idx"),
        *[_joined(f).alias(f) for f in fields])


def _joined(name: str) -> Column:
    values = F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("pos", "value"))))
    return F.nullif(F.array_join(F.transform(values, lambda v: v["value"]), "\n"), F.lit(""))


def drop_empty_records(records: DataFrame) -> DataFrame:
    """Records without any field (a bare name hit) are not records."""
    return records.where("coalesce(criteria, result, method, test_period, test_date, remarks) is not null")


def pack_paragraphs(text: Column, limit: int = 2600) -> Column:
    """Paragraphs packed into chunks of at most `limit` characters; a longer paragraph is cut."""
    paragraphs = F.filter(F.transform(F.split(T.clean(text), r"\n\s*\n+"), lambda p: T.clean(p)), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flush(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))

    def step(state: Column, p: Column) -> Column:
        pieces = F.filter(F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / limit).cast("int") - 1),
                                      lambda i: T.clean(F.substr(p, i * limit + 1, F.lit(limit)))), lambda x: x != "")
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n"), p))
        return (F.when(F.length(p) > limit, F.struct(F.concat(flush(state), pieces).alias("done"), F.lit("").alias("open")))
                .when((F.length(joined) > limit) & (state["open"] != ""), F.struct(flush(state).alias("done"), p.alias("open")))
                .otherwise(F.struct(state["done"].alias("done"), joined.alias("open"))))
    return F.aggregate(paragraphs, empty, step, flush)


def evidence_units(text: Column) -> Column:
    """Lossless pieces cut after sentence punctuation (never inside a number) and around blank or n/N lines."""
    marked = sub(free_of_mark(text), r"((?<!\d)[,，]|[,，](?!\d)|[;；。!?！？]|(?<=[다함됨음])\.(?=\s|$))", f"$1{MARK}")
    marked = sub(marked, rf"(?m)^([^\S\n{MARK}]*(?:\d+[^\S\n]*/[^\S\n]*\d+)?[^\S\n{MARK}]*(?:\n|$))", f"{MARK}$1{MARK}")
    return F.transform(F.filter(F.split(marked, MARK), lambda u: u != ""), with_mark)


def unit_rows(units: DataFrame, keys: list[str]) -> DataFrame:
    """Unit rows with character offsets; the offsets are sums of the lengths inside one text."""
    lengths = F.transform("units", lambda u: F.length(u))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.array_append(
        acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))
    rows = units.select(*keys, "units", ends.alias("ends")).select(*keys, F.posexplode("units").alias("unit_no", "unit"), "ends")
    end = F.get("ends", F.col("unit_no"))
    return rows.select(*keys, "unit_no", (end - F.length("unit")).alias("char_start"), end.alias("char_end"), "unit")


def cue_hits(pages: DataFrame, keys: list[str], terms: list[str], text: str = "text") -> DataFrame:
    """Every occurrence of a cue term (white space allowed between its letters) with its offset; pages are read once."""
    def pieces(term: str) -> Column:
        pattern = r"\s*".join(re.escape(ch) for ch in term if not ch.isspace())
        return F.transform(F.split(sub(free_of_mark(F.col(text)), f"({pattern})", f"{MARK}$1{MARK}"), MARK), with_mark)
    each = F.array(*[F.struct(F.lit(term).alias("term"), pieces(term).alias("pieces")) for term in terms])
    rows = pages.select(*keys, F.explode(each).alias("_hit")).select(*keys, "_hit.term", "_hit.pieces").where(F.size("pieces") > 1)
    # odd pieces are the hits; the lengths of all earlier pieces give the offset. Pieces are taken CUE_PIECES at a time, so that no
    # sum runs over a whole text for each hit, and offsets are made before the rows: beside a generator they are made once per row
    last = F.ceil(F.size("pieces") / CUE_PIECES).cast("int") - 1
    cut = rows.select(*keys, "term", F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("pieces", i * CUE_PIECES + 1, F.lit(CUE_PIECES))).alias("_parts"))
    sizes = F.transform("_parts", lambda part: F.aggregate(part, F.lit(0), lambda acc, p: acc + F.length(p)))
    starts = cut.select(*keys, "term", "_parts", _sums(F.lit(0), sizes).alias("_starts"))
    parts = starts.select(*keys, "term", F.explode(F.arrays_zip("_parts", "_starts")).alias("_p")).select(*keys, "term", "_p.*").where("_parts is not null")
    places = _sums(F.col("_starts"), F.transform("_parts", lambda p: F.length(p)))
    each_hit = F.zip_with("_parts", places, lambda p, at: F.struct(at.alias("char_start"), (at + F.length(p)).alias("char_end"), p.alias("quote")))
    hits = F.filter(each_hit, lambda h, i: (i % 2 == 1) & h["quote"].isNotNull())
    return parts.select(*keys, "term", hits.alias("_hits")).select(*keys, "term", F.inline("_hits"))


def _sums(first: Column, sizes: Column) -> Column:
    """Running sums of a short list of sizes, from `first` on."""
    return F.aggregate(sizes, F.array(first), lambda acc, n: F.array_append(acc, F.try_element_at(acc, F.lit(-1)) + n))


def page_label_audit(labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Printed n/N labels per declared total: observed, duplicate, out of range, non-increasing, missing ranges.

    `labels` has one row per printed label: doc, position, number, total.
    """
    keys = [doc, "total"]
    stepped = neighbour(labels.withColumn("block", block_of(F.col("position"))), keys, "block", ["position"], F.col("number"), "before")
    flow = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labels"), F.bool_or(F.coalesce(F.col("before") >= F.col("number"), F.lit(False))).alias("non_increasing"),
        F.count_if((F.col("number") < 1) | (F.col("number") > F.col("total"))).alias("out_of_range"))
    inside = labels.where("number between 1 and total").groupBy(*keys, "number").agg(F.count(F.lit(1)).alias("n"))
    gaps = neighbour(inside.withColumn("block", block_of(F.col("number"))), keys, "block", ["number"], F.col("number"), "below")
    seen = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col("n") > 1).alias("duplicates"),
        F.count_if(F.col("number") > F.coalesce("below", F.lit(0)) + 1).alias("inner_gaps"), F.max("number").alias("top"))
    out = flow.join(seen, keys, "left")
    tail = F.when(F.coalesce("top", F.lit(0)) < F.col("total"), 1).otherwise(0)
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("observed", "duplicates")}
    return out.withColumns(zero).withColumn("missing_ranges", (F.coalesce("inner_gaps", F.lit(0)) + tail).cast("bigint")).drop("inner_gaps", "top")


def ocr_suspect(text: Column) -> Column:
    """Wording typical of a scanned page: replacement characters or letters glued to digits of a unit."""
    return matches(F.coalesce(text, F.lit("")), r"\x{FFFD}|[|]{3,}|\b[lI]{3,}\b|\?{3,}")


def document_metadata(first_pages: Column) -> Column:
    """Company, title, product number, version and received date by ordered patterns on the first pages."""
    def first_of(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(first_pages, "(?U)" + p, 1)), F.lit("")) for p in patterns])
    return F.struct(
        first_of(r"(?m)^\s*(?:제조사|제조원|업체명)\s*[:：]\s*(.+)$", r"(?m)^\s*(\(?주\)?\s*\S+(?:제약|바이오\S*|약품))\s*$").alias("company"),
        first_of(r"(?m)^\s*(?:제품명|품목명)\s*[:：]\s*(.+)$", r"(?mi)^\s*(.+Summary Protocol.*)$").alias("title"),
        first_of(r"(?m)^\s*(?:제조번호|Lot No\.?)\s*[:：]\s*([A-Za-z0-9._-]+)").alias("product_no"),
        first_of(r"(?i)Ver\.?\s*([\d.]+)").alias("version"),
        first_of(r"(?m)(?:접수일|접수일자)\s*[:：]\s*(20\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2})").alias("received"))


def control_fields(remarks: Column) -> Column:
    """Positive-control value and criterion kept apart from the test's own fields."""
    lines = F.split(F.coalesce(remarks, F.lit("")), "\n")
    control = F.filter(lines, lambda x: F.trim(x).startswith("양성대조군"))

    def after(word: str) -> Column:
        pattern = rf"^\s*양성대조군\s*{word}\s*[:：]?\s*(.+)$"
        return F.get(F.filter(F.transform(control, lambda x: F.regexp_extract(x, "(?U)" + pattern, 1)), lambda v: v != ""), F.lit(0))
    return F.struct(after("(?:시험)?결과").alias("result"), after("(?:시험)?기준").alias("criteria"))
