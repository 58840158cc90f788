"""Manufacturing cross-checks: lots, stages, next-stage dates and test-date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import codes as C
from ..functions import dates as D
from ..functions.core import contains_any, let, sub
from ..functions.fields import field_value
from ..functions.text import key
from ..session import cut_lineage
from . import ordered
from .distinct import per_text
from .judgement import severity, severity_name
from .ordered import block_of, neighbour, running_last
from .permits import MANY_NAMES, containing_pairs


def lot_windows(lines: DataFrame, label: str, fields: list[str], reach: int = 8) -> DataFrame:
    """Lot occurrences: a lot label and the labelled values in the following lines, up to the next lot label.

    lines: doc_id, position, text. Values farther than `reach` lines away do not belong to the lot.
    """
    rows = lines.withColumns({"block": block_of(F.col("position")), "lot": field_value(F.col("text"), label)})
    opened = running_last(rows, ["doc_id"], "block", ["position"], F.when(F.col("lot").isNotNull(), F.struct("position", "lot")), "open")
    near = opened.where((F.col("open").isNotNull()) & (F.col("position") - F.col("open.position") <= reach))
    values = F.array(*[F.struct(F.lit(f).alias("field"), field_value(F.col("text"), f).alias("value")) for f in fields])
    long = near.select("doc_id", F.col("open.position").alias("position"), F.col("open.lot").alias("lot"), F.explode(values).alias("v")).where("v.value is not null")
    return long.select("doc_id", "position", "lot", "v.field", "v.value").dropDuplicates()


def normal_value(field: Column, value: Column) -> Column:
    """Comparable form of a field value by its kind."""
    date = let(D.date_parts(value), lambda p: F.concat_ws("-", p["y"], p["m"], p["d"]))
    amount = let(C.quantity(value), lambda q: F.concat_ws(" ", q["number"], q["unit"]))
    return (F.when(contains_any(field, ["번호", "로트"]), C.lot_code(value)).when(contains_any(field, ["년월일", "기간", "일자"]), date)
            .when(contains_any(field, ["량", "수량"]), amount).otherwise(key(value)))


def lot_agreement(occurrences: DataFrame) -> DataFrame:
    """Per document, folded lot and field: more than one distinct value fails; fewer than two values are no check."""
    named = per_text(occurrences.select("doc_id", "lot", "field", "value"), ["lot"], {"code": C.lot_code(F.col("lot"))})
    rows = per_text(named, ["field", "value"], {"v": normal_value(F.col("field"), F.col("value"))}).where("v <> ''").select("doc_id", F.col("code").alias("lot"), "field", "v")
    groups = rows.groupBy("doc_id", "lot", "field").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n >= 2")
    return groups.select("doc_id", "lot", "field", "n", F.when(F.col("lo") == F.col("hi"), "PASS").otherwise("FAIL").alias("status"))


def compare_field(field: Column, summary: Column, document: Column) -> Column:
    """Equality by kind of field; a missing side fails. Dates compare on their shared precision."""
    date = let(D.date_parts(summary), lambda a: let(D.date_parts(document), lambda b: D.same_date(a, b)))
    is_date = contains_any(field, ["년월일", "일자"])
    same = F.when(is_date, date).otherwise(normal_value(field, summary) == normal_value(field, document))
    blank = (F.coalesce(F.trim(summary), F.lit("")) == "") | (F.coalesce(F.trim(document), F.lit("")) == "")
    return F.when(~blank & F.coalesce(same, F.lit(False)), "PASS").otherwise("FAIL")


# Alternative labels of the lot, date and quantity of a stage.
ITEM_ALIASES = {"lot": ["제조번호", "로트번호", "배치번호"], "made": ["제조년월일", "제조일자", "제조일"], "amount": ["제조량", "수량", "충전량"]}


def summary_items(nodes: DataFrame) -> DataFrame:
    """One row per stage of a diagram: the first node with its lot, date and quantity by alias."""
    values = [F.coalesce(*[F.try_element_at("fields", F.lit(a)) for a in names]).alias(name) for name, names in ITEM_ALIASES.items()]
    rows = nodes.select("doc_id", "position", F.col("name").alias("stage"), key(F.col("name")).alias("stage_key"), *values)
    return rows.groupBy("doc_id", "stage_key").agg(F.min_by(F.struct("stage", "lot", "made", "amount"), "position").alias("i"),
                                                   F.min("position").alias("position")).select("doc_id", "stage_key", "position", "i.*")


def stage_occurrences(items: DataFrame, body: DataFrame) -> DataFrame:
    """Body rows with every stage they may belong to: by stage text first, else by lot, then date, then quantity.

    The same text goes before a text that contains the other one. Of the stages of a row all of its best reason are kept, so two
    stages of one lot are two rows and nothing decides between them in silence.
    items: doc_id, stage_key, lot, made, amount; body: doc_id, row_id, stage_key, lot, made, amount (normal forms).

    In a document of few items and rows that one task may hold every row meets every item, in one join; the others are joined
    by each reason.
    """
    counts = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("doc_id") for df, most in ((items, MANY_NAMES), (body, ordered.WHOLE_ROWS))]
    crowded = cut_lineage(counts[0].unionByName(counts[1]).distinct())
    if crowded.isEmpty():
        return _best_stages(_met_stages(items, body))
    few, many = ([df.join(crowded, "doc_id", kind) for df in (items, body)] for kind in ("left_anti", "left_semi"))
    return _best_stages(_met_stages(*few)).unionByName(_best_stages(_joined_stages(*many)))


def _best_stages(found: DataFrame) -> DataFrame:
    """Of the stages of a row those of its best reason."""
    place = F.rank().over(Window.partitionBy("doc_id", "row_id").orderBy("rank", "loose"))
    return found.withColumn("_place", place).where("_place = 1").select("doc_id", "row_id", "stage", "rank").distinct()


def _met_stages(items: DataFrame, body: DataFrame) -> DataFrame:
    """Rows (doc_id, row_id, stage, rank, loose): each pair of an item and a row of its document by the best of its reasons."""
    reasons = ("lot", "made", "amount")
    known = items.select("doc_id", F.col("stage_key").alias("stage"), *[F.col(c).alias(f"_{c}") for c in reasons])
    rows = body.select("doc_id", "row_id", F.col("stage_key").alias("written"), *reasons)
    stage, written = F.col("stage"), F.col("written")
    rank = F.when((stage != "") & (written != "") & (stage.contains(written) | written.contains(stage)), 1)
    for k, c in enumerate(reasons, 2):
        rank = rank.when((F.col(c) != "") & (F.col(c) == F.col(f"_{c}")), k)
    # estimated by compressed files, the items would seem small enough to be sent
    met = rows.hint("merge").join(known, "doc_id").withColumn("rank", rank).where("rank is not null")
    return met.select("doc_id", "row_id", "stage", "rank", ((F.col("rank") == 1) & (stage != written)).alias("loose"))


def _joined_stages(items: DataFrame, body: DataFrame) -> DataFrame:
    """The same pairs in documents of any size, and each also by its other reasons."""
    texts = containing_pairs(items.select("doc_id", F.col("stage_key").alias("stage")), body.select("doc_id", F.col("stage_key").alias("written")), "doc_id", "stage", "written")
    found = texts.join(body.select("doc_id", "row_id", F.col("stage_key").alias("written")), ["doc_id", "written"]).select(
        "doc_id", "row_id", "stage", F.lit(1).alias("rank"), (F.col("stage") != F.col("written")).alias("loose"))
    for rank, column in enumerate(("lot", "made", "amount"), 2):
        known = items.select("doc_id", F.col("stage_key").alias("stage"), F.col(column).alias("k")).where("k is not null and k <> ''").distinct()
        rows = body.select("doc_id", "row_id", F.col(column).alias("k")).where("k is not null and k <> ''")
        found = found.unionByName(known.join(rows, ["doc_id", "k"]).select("doc_id", "row_id", "stage", F.lit(rank).alias("rank"), F.lit(False).alias("loose")))
    return found


def next_stage_dates(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Date of the next stage: the earliest successor over the edges, else the next later date of the document.

    items: doc_id, node_id, made (date); edges: doc_id, src, dst.
    """
    later = items.select("doc_id", F.col("node_id").alias("dst"), F.col("made").alias("next")).where("next is not null")
    by_edge = edges.join(later, ["doc_id", "dst"]).groupBy("doc_id", F.col("src").alias("node_id")).agg(F.min("next").alias("edge_next"))
    dates = items.where("made is not null").select("doc_id", "made").distinct().withColumn("block", F.year("made"))
    following = neighbour(dates, ["doc_id"], "block", ["made"], F.col("made"), "date_next", following=True).drop("block")
    out = items.join(by_edge, ["doc_id", "node_id"], "left").join(following, ["doc_id", "made"], "left")
    return out.select("doc_id", "node_id", "made", F.coalesce("edge_next", "date_next").alias("next_date"))


def test_date_window(tests: DataFrame, windows: DataFrame) -> DataFrame:
    """The whole written interval of a test lies in [stage date, next date); an unread date holds.

    tests: doc_id, test_id, stage_key, test_period; windows: doc_id, stage_key, lower, upper.
    """
    bounds = windows.groupBy("doc_id", "stage_key").agg(F.min("lower").alias("lower"), F.min("upper").alias("upper")).where("lower is not null")
    rows = tests.withColumn("span", D.date_interval(F.col("test_period"))).join(bounds, ["doc_id", "stage_key"])
    ok = (F.col("span.lo") >= F.col("lower")) & (F.col("upper").isNull() | (F.col("span.hi") < F.col("upper")))
    unread = F.col("span.lo").isNull() | F.col("span.hi").isNull()
    return rows.select("doc_id", "test_id", "stage_key", F.when(unread, "HOLD").when(ok, "PASS").otherwise("FAIL").alias("status"))


def stage_verdicts(required: DataFrame, compared: DataFrame) -> DataFrame:
    """Only supplied values are compared; a required field nobody compared holds; the worst status decides.

    required: doc_id, stage, field; compared: doc_id, stage, field, status.
    """
    seen = compared.groupBy("doc_id", "stage", "field").agg(F.max(severity(F.col("status"))).alias("level"))
    joined = required.select("doc_id", "stage", "field").distinct().join(seen, ["doc_id", "stage", "field"], "full_outer")
    return joined.groupBy("doc_id", "stage").agg(
        severity_name(F.max(F.coalesce("level", F.lit(2)))).alias("status"), F.count(F.lit(1)).alias("fields"), F.count_if(F.col("level").isNull()).alias("unseen"))


# Spelling repairs and the meaning-bearing words of stage names.
_STAGE_REPAIRS = [(r"e\s*\.?\s*coll?i", "ecoli"), ("chol", "cho"), ("컴포넌트", "component"), (r"나노\s*피티클", "나노파티클")]
STAGE_TERMS = ["cho", "ecoli", "componenta", "componentb", "component", "마스터세포주", "제조용세포주", "세포주", "중간체원액", "중간체",
               "최종원액", "원액", "완제의약품", "완제", "의약품", "나노파티클", "나노"]


def stage_key(name: Column) -> Column:
    """Folded stage name: known spelling repairs applied, separators removed."""
    out = F.lower(F.translate(F.coalesce(name, F.lit("")), "∙ㆍ·：，", "...:,"))
    for pattern, plain in _STAGE_REPAIRS:
        out = sub(out, pattern, plain)
    return sub(out, r"[\s_\-./(){}\[\]:,]+", "")


def stage_terms(folded: Column) -> Column:
    """Meaning-bearing words that occur in a folded stage name."""
    return F.filter(F.array(*[F.lit(x) for x in STAGE_TERMS]), lambda w: folded.contains(w))


@pandas_udf(DoubleType())
def _block_ratio(a, b):
    """Share of letters in common matching blocks of two short names."""
    import difflib
    import pandas as pd
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def fuzzy_stages(labels: DataFrame, stages: DataFrame, accept: float = 0.55) -> DataFrame:
    """Best stage per label: equal 1, contained 0.95, else 0.45 letters + 0.55 shared words with a component bonus.

    Without a shared word a pair stays at 0.42 and can never be accepted, so pairs are formed only through a
    shared word or through containment; the letter ratio runs on distinct pairs.
    labels: doc_id, label; stages: doc_id, stage, position.
    """
    a = labels.select("doc_id", stage_key(F.col("label")).alias("lk")).where("lk <> ''").distinct()
    b = stages.select("doc_id", stage_key(F.col("stage")).alias("sk")).where("sk <> ''").distinct()
    words_a = a.select("doc_id", "lk", F.explode(stage_terms(F.col("lk"))).alias("w"))
    words_b = b.select("doc_id", "sk", F.explode(stage_terms(F.col("sk"))).alias("w"))
    shared = words_a.hint("merge").join(words_b, ["doc_id", "w"]).select("doc_id", "lk", "sk")
    pairs = shared.unionByName(containing_pairs(a, b, "doc_id", "lk", "sk")).select("lk", "sk").distinct()
    ta, tb = stage_terms(F.col("lk")), stage_terms(F.col("sk"))
    both, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    words = F.when(union > 0, both / union).otherwise(0.0)
    inside = (F.length("lk") >= 4) & (F.length("sk") >= 4) & (F.col("lk").contains(F.col("sk")) | F.col("sk").contains(F.col("lk")))
    ca, cb = (F.regexp_extract(c, "component([a-z0-9]+)", 1) for c in ("lk", "sk"))
    bonus = F.when((ca != "") & (cb != ""), F.when(ca == cb, 0.2).otherwise(-0.45)).otherwise(0.0)
    mixed = F.col("ratio") * 0.45 + words * 0.55 + bonus
    mixed = F.when(both == 0, F.least(mixed, F.lit(0.42))).otherwise(mixed)
    score = F.when(F.col("lk") == F.col("sk"), 1.0).when(inside, 0.95).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))
    scored = pairs.withColumn("ratio", _block_ratio("lk", "sk")).withColumn("score", score).where(F.col("score") >= accept).select("lk", "sk", "score")
    named = labels.withColumn("lk", stage_key(F.col("label"))).join(scored, "lk").hint("merge").join(
        stages.withColumn("sk", stage_key(F.col("stage"))), ["doc_id", "sk"])
    best = named.groupBy("doc_id", "label").agg(F.max(F.struct("score", (-F.col("position")).alias("first"), "stage")).alias("b"))
    return best.select("doc_id", "label", "b.stage", F.col("b.score").alias("score"))
