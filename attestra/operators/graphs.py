"""Process graphs: nodes from cells, edges from layout or phases, checks, layers and lanes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key
from ..session import cut_lineage, shared_folder
from .ordered import block_of, neighbour, row_numbers, running_last, running_sum


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: repeated ids or names, edges without an end, repeated edges, more than one diagram.

    nodes: doc_id, diagram, node_id, name; edges: doc_id, src, dst.
    """
    def repeats(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        groups = df.groupBy("doc_id", *cols).agg(F.count(F.lit(1)).alias("n"))
        return groups.where("n > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    known = nodes.select("doc_id", "node_id").distinct()
    ends = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("node_id"))
    dangling = ends.join(known, ["doc_id", "node_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("dangling"))
    diagrams = nodes.groupBy("doc_id").agg((F.min("diagram") != F.max("diagram")).alias("several_diagrams"))
    out = diagrams
    for part in (repeats(nodes, ["node_id"], "repeated_ids"), repeats(nodes.withColumn("k", key(F.col("name"))), ["k"], "repeated_names"),
                 dangling, repeats(edges, ["src", "dst"], "repeated_edges")):
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0, ["repeated_ids", "repeated_names", "dangling", "repeated_edges"])


def layers(nodes: DataFrame, edges: DataFrame, checkpoint_every: int = 32) -> DataFrame:
    """Longest-path layer of every node; documents with a cycle are marked and get no layer.

    Nodes without an open predecessor are peeled off round by round, the round is their layer, and only the successors of the
    peeled lose predecessors. A document in which no node is free stalls: the rest of it holds a cycle and leaves the rounds at once.
    The peeled nodes of every so many rounds are written to the shared folder, so plans stay short however long the paths are.
    Edges with an end that is no node are left to `graph_errors`; repeated edges count once.
    """
    spark = nodes.sparkSession
    known = nodes.select("doc_id", "node_id").distinct()
    links = edges.select("doc_id", "src", "dst").distinct()
    for end in ("src", "dst"):
        links = links.join(known.withColumnRenamed("node_id", end), ["doc_id", end], "left_semi")
    links = cut_lineage(links)
    waiting = links.groupBy("doc_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("open"))
    state = cut_lineage(known.join(waiting, ["doc_id", "node_id"], "left").withColumn("open", F.coalesce("open", F.lit(0).cast("bigint"))))
    folder, peeled, step = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}", None, 0
    ways = links.withColumnRenamed("src", "node_id")
    while True:
        free = state.where("open = 0").select("doc_id", "node_id")
        layer = free.withColumn("layer", F.lit(step))
        peeled = layer if peeled is None else peeled.unionByName(layer)
        freed = free.join(ways, ["doc_id", "node_id"]).groupBy("doc_id", F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("gone"))
        left = state.where("open > 0").join(freed, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (F.col("open") - F.coalesce("gone", F.lit(0))).alias("open"))
        moving = left.where("open = 0").select("doc_id").distinct()
        state = cut_lineage(left.join(moving, "doc_id", "left_semi"))
        if state.isEmpty():
            break
        step += 1
        if step % checkpoint_every == 0:
            peeled.write.parquet(f"{folder}/{step}")
            peeled = None
    if step >= checkpoint_every:
        stored = spark.read.schema(known.withColumn("layer", F.lit(0)).schema).parquet(*[f"{folder}/{k}" for k in range(checkpoint_every, step + 1, checkpoint_every)])
        peeled = stored if peeled is None else peeled.unionByName(stored)
    placed = known.join(peeled, ["doc_id", "node_id"], "left")
    cyclic = placed.where("layer is null").select("doc_id").distinct().withColumn("cyclic", F.lit(True))
    marked = placed.join(cyclic, "doc_id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return marked.select("doc_id", "node_id", F.when(~F.col("cyclic"), F.col("layer")).alias("layer"), "cyclic")


def lanes(layered: DataFrame) -> DataFrame:
    """Position inside the layer; nodes outside the process follow in the last layer.

    layered: doc_id, node_id, layer, position, kind.
    """
    last = layered.where("kind = 'process'").groupBy("doc_id").agg(F.max("layer").alias("last_layer"))
    placed = layered.join(last, "doc_id", "left").withColumn(
        "layer", F.when(F.col("kind") == "process", F.col("layer")).otherwise(F.coalesce("last_layer", F.lit(0)))).drop("last_layer")
    side = F.when(F.col("kind") == "process", 0).otherwise(1)
    # one number orders process nodes before the others, then by position
    ordered = placed.withColumns({"side": side, "block": side * F.lit(1 << 40) + block_of(F.col("position"))})
    return row_numbers(ordered, ["doc_id", "layer"], "block", ["side", "position"], "lane").withColumn("lane", F.col("lane") - 1).drop("side", "block")


def chain_edges(nodes: DataFrame, merged: str = "Merged") -> DataFrame:
    """Nodes of a component follow each other; the first merged node is fed by the last node of every component.

    nodes: doc_id, position, node_id, component. Components that begin after the merge only form their own chain.
    """
    inside = neighbour(nodes.withColumn("block", block_of(F.col("position"))), ["doc_id", "component"], "block", ["position"], F.col("node_id"), "before")
    chain = inside.where("before is not null").select("doc_id", F.col("before").alias("src"), F.col("node_id").alias("dst"))
    joint = nodes.where(F.col("component") == merged).groupBy("doc_id").agg(F.min(F.struct("position", "node_id")).alias("m"))
    feeders = nodes.where(F.col("component") != merged).join(joint, "doc_id").where(F.col("position") < F.col("m.position")).groupBy("doc_id", "component").agg(
        F.max_by("node_id", "position").alias("src"), F.first("m.node_id").alias("dst"))
    return chain.unionByName(feeders.select("doc_id", "src", "dst"))


def phase_edges(nodes: DataFrame) -> DataFrame:
    """Edges between consecutive phases: same prefix first, then pairwise when equally many are left, else all of them.

    nodes: doc_id, node_id, position, phase (null goes to the last phase), prefix.
    """
    last = nodes.groupBy("doc_id").agg(F.max("phase").alias("last_phase"))
    placed = nodes.join(last, "doc_id").withColumn("phase", F.coalesce("phase", "last_phase")).where("phase is not null")
    steps = placed.select("doc_id", "phase").distinct()
    following = F.lead("phase").over(Window.partitionBy("doc_id").orderBy("phase"))
    steps = steps.withColumn("next_phase", following).where("next_phase is not null")
    src = placed.join(steps, ["doc_id", "phase"]).select("doc_id", "phase", "next_phase", F.col("node_id").alias("src"), F.col("position").alias("sp"), "prefix")
    dst = placed.join(steps.select("doc_id", F.col("phase").alias("from_phase"), F.col("next_phase").alias("phase")), ["doc_id", "phase"]).select(
        "doc_id", F.col("from_phase").alias("phase"), F.col("node_id").alias("dst"), F.col("position").alias("dp"), "prefix")
    same = src.where("prefix is not null").join(dst.where("prefix is not null"), ["doc_id", "phase", "prefix"]).select("doc_id", "phase", "src", "dst")
    free_src = src.join(same.select("doc_id", "phase", "src").distinct(), ["doc_id", "phase", "src"], "left_anti")
    free_dst = dst.join(same.select("doc_id", "phase", "dst").distinct(), ["doc_id", "phase", "dst"], "left_anti")
    counts = free_src.groupBy("doc_id", "phase").agg(F.count(F.lit(1)).alias("ns")).join(
        free_dst.groupBy("doc_id", "phase").agg(F.count(F.lit(1)).alias("nd")), ["doc_id", "phase"], "left").na.fill(0, ["nd"])
    numbered_src = row_numbers(free_src.withColumn("block", block_of(F.col("sp"))), ["doc_id", "phase"], "block", ["sp"], "i").drop("block").join(counts, ["doc_id", "phase"])
    numbered_dst = row_numbers(free_dst.withColumn("block", block_of(F.col("dp"))), ["doc_id", "phase"], "block", ["dp"], "i").drop("block")
    pairwise = numbered_src.where("ns = nd").join(numbered_dst, ["doc_id", "phase", "i"]).select("doc_id", "phase", "src", "dst")
    every = numbered_src.where("nd > 0 and ns <> nd").join(free_dst, ["doc_id", "phase"]).select("doc_id", "phase", "src", "dst")
    closed = numbered_src.where("nd = 0").join(dst.drop("prefix"), ["doc_id", "phase"]).select("doc_id", "phase", "src", "dst")
    return same.unionByName(pairwise).unionByName(every).unionByName(closed).select("doc_id", "src", "dst")


def layout_rows(nodes: DataFrame, keys: list[str], tolerance: float = 34.0) -> DataFrame:
    """Row number of every node by height: a node joins the open row while it stays near the row's mean height.

    A jump above the tolerance always opens a row, so heights are first cut at such jumps; only inside one
    of these runs the mean is followed height by height.
    """
    heights = nodes.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    stepped = neighbour(heights.withColumn("block", F.floor(F.col("y") / 4096).cast("bigint")), keys, "block", ["y"], F.col("y"), "above")
    jump = F.when(F.col("above").isNull() | (F.col("y") - F.col("above") > tolerance), 1).otherwise(0)
    runs = running_sum(stepped, keys, "block", ["y"], jump, "run")
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("count"), F.array().cast("array<struct<y:double,row:int>>").alias("out"))

    def follow(state: Column, h: Column) -> Column:
        far = (state["count"] == 0) | (F.abs(h["y"] - state["total"] / F.greatest(state["count"], F.lit(1))) > tolerance)
        row = F.when(far, state["row"] + 1).otherwise(state["row"])
        return F.struct(row.alias("row"), F.when(far, h["y"] * h["n"]).otherwise(state["total"] + h["y"] * h["n"]).alias("total"),
                        F.when(far, h["n"]).otherwise(state["count"] + h["n"]).alias("count"),
                        F.array_append(state["out"], F.struct(h["y"].alias("y"), row.alias("row"))).alias("out"))
    folded = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("hs")).select(
        *keys, "run", F.explode(F.aggregate("hs", start, follow)["out"]).alias("o")).select(*keys, "run", "o.y", "o.row")
    rows = folded.select(*keys, "run", "row").distinct().withColumn("block", block_of(F.col("run")))
    numbered = row_numbers(rows, keys, "block", ["run", "row"], "layer").drop("block")
    return nodes.join(folded.join(numbered, [*keys, "run", "row"]).select(*keys, "y", "layer"), [*keys, "y"])


def layout_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between consecutive rows of a page by the sizes of the two rows and the nearest horizontal position.

    nodes: keys, node_id, name, x, y. Of equally near nodes the left one is taken.
    """
    # every branch below reads the rows, so they are computed once
    placed = cut_lineage(layout_rows(nodes, keys))
    across = placed.withColumn("block", F.floor(F.col("x") / 1024).cast("bigint"))
    ranked = row_numbers(across, [*keys, "layer"], "block", ["x", "node_id"], "i").drop("block")
    sizes = placed.groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("n"), (F.min("name") == F.max("name")).alias("one_name"))
    up = ranked.join(sizes, [*keys, "layer"]).select(*keys, F.col("layer").alias("step"), F.col("node_id").alias("src"), F.col("x").alias("sx"), F.col("i"), F.col("n").alias("ns"))
    down = ranked.join(sizes, [*keys, "layer"]).select(*keys, (F.col("layer") - 1).alias("step"), F.col("node_id").alias("dst"), F.col("x").alias("dx"), F.col("i"), F.col("n").alias("nd"), F.col("one_name"))
    below = sizes.select(*keys, (F.col("layer") - 1).alias("step"), F.col("n").alias("nd"), "one_name")
    up = up.join(below, [*keys, "step"])
    above = sizes.select(*keys, F.col("layer").alias("step"), F.col("n").alias("ns"))
    down = down.join(above, [*keys, "step"])
    ends = [*keys, "src", "dst"]
    equal = up.where("ns = nd").join(down.select(*keys, "step", "i", "dst"), [*keys, "step", "i"]).select(*ends)
    only = up.where("ns <> nd and nd = 1").join(down.select(*keys, "step", "dst"), [*keys, "step"]).select(*ends)
    same_name = up.where("ns <> nd and nd > 1 and ns > 1 and one_name").join(down.select(*keys, "step", "dst"), [*keys, "step"]).select(*ends)
    few = up.where("ns = 1 and nd > 1")
    many = up.where("ns > nd and nd > 1 and not one_name")
    from_up = nearest(few.unionByName(many).select(*keys, "step", "src", "sx"), "src", "sx", down.select(*keys, "step", "dst", "dx"), "dst", "dx", [*keys, "step"])
    wide = down.where("nd > ns and ns > 1 and not one_name")
    from_down = nearest(wide.select(*keys, "step", "dst", "dx"), "dst", "dx", up.select(*keys, "step", "src", "sx"), "src", "sx", [*keys, "step"])
    out = equal.unionByName(only).unionByName(same_name).unionByName(from_up.select(*ends)).unionByName(from_down.select(*ends))
    return out.where("src <> dst").distinct()


def nearest(left: DataFrame, a: str, ax: str, right: DataFrame, b: str, bx: str, keys: list[str]) -> DataFrame:
    """For every left row the right row with the closest value, the smaller one on a tie; no pairs are formed.

    Both sides are merged into one order; the last right row at or below and the first above are the only candidates.
    """
    spots = right.groupBy(*keys, F.col(bx).alias("v")).agg(F.min(b).alias("r"))
    merged = left.select(*keys, F.col(ax).alias("v"), F.col(a).alias("l"), F.lit(None).cast(spots.schema["r"].dataType).alias("r"), F.lit(1).alias("side")).unionByName(
        spots.select(*keys, "v", F.lit(None).cast(left.schema[a].dataType).alias("l"), "r", F.lit(0).alias("side")))
    merged = merged.withColumns({"up": F.col("v"), "back": -F.col("v"), "block": F.floor(F.col("v") / 1024).cast("bigint"),
                                 "back_block": F.floor(-F.col("v") / 1024).cast("bigint"), "back_side": -F.col("side")})
    spot = F.when(F.col("r").isNotNull(), F.struct("v", "r"))
    low = running_last(merged, keys, "block", ["up", "side"], spot, "low")
    both = running_last(low, keys, "back_block", ["back", "back_side"], spot, "high")
    take_low = F.col("low").isNotNull() & (F.col("high").isNull() | (F.col("v") - F.col("low.v") <= F.col("high.v") - F.col("v")))
    return both.where("l is not null").select(*keys, F.col("l").alias(a), F.when(take_low, F.col("low.r")).otherwise(F.col("high.r")).alias(b))


def choose_graph(extracted: DataFrame, exported: DataFrame) -> DataFrame:
    """The extracted graph is used only if its names contain every exported process.

    Both: doc_id, name.
    """
    missing = exported.select("doc_id", key(F.col("name")).alias("k")).join(extracted.select("doc_id", key(F.col("name")).alias("k")), ["doc_id", "k"], "left_anti")
    lost = missing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    docs = exported.select("doc_id").unionByName(extracted.select("doc_id")).distinct()
    return docs.join(lost, "doc_id", "left").select("doc_id", F.when(F.col("missing").isNull(), "extracted").otherwise("inferred").alias("graph"))


def attach_counts(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts joined to nodes by unique folded name; summary names without a node are reported as errors."""
    named = nodes.select("doc_id", "node_id", key(F.col("name")).alias("k"))
    unique = named.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("same"), F.min("node_id").alias("node_id"))
    c = counts.withColumn("k", key(F.col("name")))
    joined = c.join(unique, ["doc_id", "k"], "left")
    problem = F.when(F.col("same").isNull(), "unknown_name").when(F.col("same") > 1, "ambiguous_name")
    return joined.select("doc_id", "name", F.when(problem.isNull(), F.col("node_id")).alias("node_id"), "total", problem.alias("problem"))


def nodes_from_cells(cells: DataFrame, labels: list[str], name_label: str) -> DataFrame:
    """Diagram nodes from two-column cells: a name row opens a node, the labelled rows below fill its fields.

    cells: doc_id, position, label, value.
    """
    opened = running_sum(cells.withColumn("block", block_of(F.col("position"))), ["doc_id"], "block", ["position"],
                         F.when(F.col("label") == name_label, 1).otherwise(0), "node_no")
    known = opened.where(F.col("label").isin([name_label, *labels]) & (F.col("node_no") > 0))
    fields = [F.min(F.when(F.col("label") == x, F.struct("position", "value"))).alias(x) for x in labels]
    rows = known.groupBy("doc_id", "node_no").agg(F.max(F.when(F.col("label") == name_label, F.col("value"))).alias("name"), *fields)
    pairs = F.filter(F.array(*[F.struct(F.lit(x).alias("key"), F.col(f"`{x}`.value").alias("value")) for x in labels]), lambda p: p["value"].isNotNull())
    return rows.select("doc_id", "node_no", "name", F.map_from_entries(pairs).alias("fields"))
