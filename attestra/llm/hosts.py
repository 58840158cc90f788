"""URL filters by link-graph propagation, in DataFrame operations only.

Rules on host suffix and path prefix judge the pages they fit. The pages they allow make their hosts trusted seeds, those they
block distrusted ones. Trust follows links (personalised PageRank), distrust goes against them; a host whose share of
distrust reaches a threshold is blocked, which decides pages without a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?((?:https?:)?//[^"'\s<>]+)"""
DAMPING = 0.85
TOLERANCE = 1e-9
DISTRUST_SHARE = 0.75


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end; A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, of rules (action, host/path); a block goes before an allow of equal length."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        suffix, slash, prefix = rule.partition("/")
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(slash + prefix))
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, verdict).otherwise(action)
    return name, action


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Columns source, target, share: absolute links between different hosts, as shares of what the source links to."""
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), lambda link: host_of(F.concat(F.lit(":"), F.regexp_replace(link, "^(?i)https?:", ""))))))
    links = pages.select(host_of(F.col(url)).alias("source"), found.alias("target"))
    pairs = links.where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("source").agg(F.sum("n").alias("all"))
    return pairs.join(totals, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int | None = None) -> DataFrame:
    """Columns host, trust, distrust after the propagation; seeds are (host, trust, distrust) weights, each summing to one or zero.

    Steps go on until no score changes by TOLERANCE or more and no further host is reached, so one at the end of a long
    chain of links gets its scores too; `steps` ends them earlier.
    """
    ahead = edges.select(F.lit(True).alias("good"), F.col("source").alias("host"), F.col("target").alias("to"), "share")
    against = edges.groupBy("target").agg(F.sum("share").alias("all")).join(edges, "target")
    back = against.select(F.lit(False).alias("good"), F.col("target").alias("host"), F.col("source").alias("to"), (F.col("share") / F.col("all")).alias("share"))
    ways = stored(ahead.unionByName(back))
    start = (seeds.select("host", F.lit(True).alias("good"), F.col("trust").alias("seed"))
             .unionByName(seeds.select("host", F.lit(False).alias("good"), F.col("distrust").alias("seed"))))
    start = stored(start.withColumn("score", F.col("seed")))
    scores = start
    step, reached, going = 0, 0, not ways.isEmpty()
    while going and step != steps:
        step += 1
        moved = (scores.where("score > 0").join(ways, ["host", "good"])
                 .groupBy(F.col("to").alias("host"), "good").agg(F.sum(F.col("score") * F.col("share")).alias("come")))
        before = scores.select("host", "good", "seed", F.col("score").alias("old"))
        both = before.join(moved, ["host", "good"], "full").fillna(0.0, ["seed", "old", "come"])
        scores = stored(both.select("host", "good", "seed", ((1 - damping) * F.col("seed") + damping * F.col("come")).alias("score"), "old"))
        change, now = scores.agg(F.max(F.abs(F.col("score") - F.col("old"))), F.count_if(F.col("score") > 0)).first()
        scores = scores.drop("old")
        going, reached = change is not None and (change >= TOLERANCE or now > reached), now
    value = lambda good: F.max(F.when(F.col("good") == good, F.col("score"))).alias("trust" if good else "distrust")
    return scores.groupBy("host").agg(value(True), value(False)).fillna(0.0)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html",
          share: float = DISTRUST_SHARE) -> DataFrame:
    """Key, host, path, rule and verdict (allow or block) of every page; other columns are dropped.

    Without a rule the host decides: block if distrust is at least `share` of its trust and distrust together, allow if it is
    less or the host has neither, as a null or malformed url (empty host). Null html has no links; repeated rows are
    separate pages. An empty table gives an empty result. Rules are few enough for a plan (thousands).
    """
    rows = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "action": action})
    marks = rows.where("action is not null and host <> ''").groupBy("host").agg(
        F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust"))
    marks = stored(marks)
    sums = marks.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    seeds = marks.select("host", *[(F.col(c) / F.lit(float(max(1, sums[c] or 0)))).alias(c) for c in ("trust", "distrust")])
    ranks = propagate(seeds, host_edges(pages, url, html))
    blocked = ranks.where((F.col("distrust") > 0) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust")))).select("host", F.lit("block").alias("by_host"))
    return (rows.join(blocked, "host", "left")
            .select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("action", "by_host", F.lit("allow")).alias("verdict")))
