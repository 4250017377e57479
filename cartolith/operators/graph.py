"""Call and class graphs: adjacency, bounded reachability, cycles, statistics, layout and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import Scratch


def adjacency(edges: DataFrame) -> DataFrame:
    """Each source with its distinct targets in order."""
    return edges.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_set("target")), lambda x: x.cast("string")), ",").alias("targets"), F.countDistinct("target").alias("n_targets"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local session without one gets a default."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint()


def reachable(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the nodes within `max_depth` steps of the starts and their least depth.

    A frontier moves one step a round and leaves out what was seen; rounds are as many as the depth. Edges and each
    frontier are checkpointed to the shared folder, so a round reads what the last one wrote and plans stay small.
    """
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    frontier, steps = seen, cut_lineage(edges.select(F.col("source").alias("node"), "target").distinct())
    for depth in range(1, max_depth + 1):
        following = frontier.join(steps, "node").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(following)
        seen = seen.unionByName(frontier)
    return seen


def paths(spark, edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """All simple paths from the starts, and those steps that close a cycle (marked and not followed).

    Open paths are a frontier that moves one step a round, checkpointed like that of `reachable`, so no bound on rows applies.
    """
    steps = cut_lineage(edges.select(F.col("source").alias("target"), F.col("target").alias("next")).distinct())
    walked = start.select(F.lit(None).cast("bigint").alias("source"), F.col("node").alias("target"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("closes"))
    frontier = walked
    for depth in range(1, max_depth + 1):
        step = frontier.filter("not closes").join(steps, "target")
        frontier = cut_lineage(step.select(F.col("target").alias("source"), F.col("next").alias("target"), F.lit(depth).alias("depth"), F.array_append("path", F.col("next")).alias("path"), F.array_contains("path", F.col("next")).alias("closes")))
        walked = walked.unionByName(frontier)
    return walked


def _spread(edges: DataFrame, colour: DataFrame, scratch: Scratch) -> DataFrame:
    """The greatest colour that reaches each node: (node, colour), a step a round over the nodes that changed."""
    moved = colour
    while True:
        offered = edges.join(moved.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("offer"))
        following = scratch.write(colour.join(offered, "node", "left").select("node", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") > F.col("colour")).alias("moved")))
        moved, colour = following.filter("moved").select("node", "colour"), following.select("node", "colour")
        if moved.isEmpty():
            return colour


def _marked(edges: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(source, target, gone) of the edges between nodes that have edges both in and out; gone is 1 if the target goes
    this turn, 2 if the source does, else 0.

    A node may go if its edges in times its edges out are no more than both together, so that taking it out adds no edge.
    Of two such neighbours the one of greater hash goes first, so no two neighbours go in the same turn.
    """
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degrees = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).filter("i * o <= i + o")
    light = scratch.write(degrees.select("node", (F.col("i") * F.col("o") == 0).alias("ends")))
    at = lambda nodes, end, flag: nodes.select(F.col("node").alias(end), F.col("ends").alias(flag))
    both = edges.join(at(light, "source", "s"), "source", "left").join(at(light, "target", "t"), "target", "left").filter("not coalesce(s, false) and not coalesce(t, false)")
    both = scratch.write(both.select("source", "target", F.col("s").isNotNull().alias("s"), F.col("t").isNotNull().alias("t")))
    rank = lambda end: F.struct(F.xxhash64(end, F.lit(turn)), end)
    waits = scratch.write(both.filter("s and t").select(F.when(rank("source") < rank("target"), F.col("source")).otherwise(F.col("target")).alias("node"), F.lit(True).alias("ends")).distinct())
    told = both.join(at(waits, "source", "s_waits"), "source", "left").join(at(waits, "target", "t_waits"), "target", "left")
    marked = scratch.write(told.select("source", "target", F.when(F.expr("t and t_waits is null"), 1).when(F.expr("s and s_waits is null"), 2).otherwise(0).alias("gone")))
    for passed in (light, both, waits):
        scratch.drop(passed)
    return marked


def _coloured(left: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of whole components, at least that of the greatest node: the greatest node that reaches a node colours
    it, and walking back from each colour's own node within its colour gives that node's component."""
    nodes = left.select(F.col("source").alias("node")).unionByName(left.select(F.col("target").alias("node"))).distinct()
    colour = _spread(left, scratch.write(nodes.select("node", F.col("node").alias("colour"))), scratch)
    ends = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("c1")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("c2")), "target")
    back = scratch.write(ends.filter("c1 = c2").select(F.col("target").alias("source"), F.col("source").alias("target")))
    found = frontier = scratch.write(colour.filter("node = colour").select("node", F.col("colour").alias("label")))
    while not frontier.isEmpty():
        step = frontier.select(F.col("node").alias("source"), "label").join(back, "source").select(F.col("target").alias("node"), "label").distinct()
        frontier = scratch.write(step.join(found, "node", "left_anti"))
        found = found.unionByName(frontier)
    return scratch.write(found)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node, the component named by its least node: nodes that reach each other.

    Nodes of few edges are taken out, turn by turn, each of their sources then leading to each of their targets; what is
    left reaches each other as before, over shorter paths. Where a turn takes out less than a tenth of the edges, the
    components of the greatest nodes are found by colours and go whole. At last the nodes taken out come back, the
    last first: one is in the component that one of its sources and one of its targets share, or else alone.
    Paths shrink by a share a turn, so turns grow with the logarithm of their length as long as taking out goes on.
    """
    scratch = Scratch(edges.sparkSession, "components")  # its tables have their true sizes; a checkpoint has an estimate that grows by every join
    edges = scratch.write(edges.select("source", "target").distinct())
    left = edges.filter("source <> target")
    taken, known, n = [], None, left.count()
    while n:
        marked = _marked(left, len(taken), scratch)
        taken.append(marked)
        over = marked.filter("gone = 1").select("source", F.col("target").alias("node")).join(marked.filter("gone = 2").select(F.col("source").alias("node"), "target"), "node")
        left = scratch.write(marked.filter("gone = 0").select("source", "target").unionByName(over.select("source", "target").filter("source <> target")).distinct())
        before, n = n, left.count()
        if n * 10 > before * 9:
            found = _coloured(left, scratch)
            known = found if known is None else known.unionByName(found)
            left = scratch.write(left.join(found.select(F.col("node").alias("source")), "source", "left_anti").join(found.select(F.col("node").alias("target")), "target", "left_anti"))
            n = left.count()
    for marked in reversed(taken):
        beside = marked.filter("gone > 0").select(F.expr("if(gone = 1, target, source)").alias("taken"), F.expr("if(gone = 1, source, target)").alias("node"), "gone")
        beside = beside.withColumn("label", F.col("node")) if known is None else beside.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        back = scratch.write(beside.groupBy(F.col("taken").alias("node"), "label").agg(F.min("gone").alias("least"), F.max("gone").alias("most")).filter("least < most").select("node", "label"))
        known = back if known is None else known.unionByName(back)
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    if known is None:
        return nodes.select("node", F.col("node").alias("component"))
    known = scratch.write(known.unionByName(known.select(F.col("label").alias("node"), "label")).distinct())
    named = known.join(known.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges that lie on a cycle: those within a component, and those from a node to itself."""
    c = components.select(F.col("node").alias("source"), F.col("component").alias("c1")), components.select(F.col("node").alias("target"), F.col("component").alias("c2"))
    return edges.select("source", "target").distinct().join(c[0], "source").join(c[1], "target").filter("c1 = c2").select("source", "target", F.col("c1").alias("component"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def layout(nodes: DataFrame, dx: int = 280, dy: int = 120) -> DataFrame:
    """Places by depth and rank within it."""
    rank = F.row_number().over(Window.partitionBy("depth").orderBy("node")) - 1
    return nodes.select("node", "depth", (F.col("depth") * dx).alias("x"), (rank * dy).alias("y"))


def tree_nodes(paths_table: DataFrame, path: str) -> DataFrame:
    """Every prefix of every path: node, parent, depth, whether it is a directory, and the files below it."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("node"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), n.alias("depth"), (n < F.size(parts)).alias("is_dir")))
    flat = paths_table.select(F.explode(prefixes).alias("p")).select("p.*")
    return flat.groupBy("node", "parent", "depth").agg(F.bool_or("is_dir").alias("is_dir"), F.count("*").alias("files"))


def roll_up(paths_table: DataFrame, path: str, changed: str) -> DataFrame:
    """Directories with whether anything below them has changed."""
    parts = F.split(F.col(path), "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return paths_table.select(F.explode(above).alias("directory"), changed).groupBy("directory").agg(F.bool_or(changed).alias("modified"), F.count("*").alias("files"))
