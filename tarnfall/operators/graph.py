"""Traversal and order on property graphs.

Frontiers are DataFrames; a round is a join of the frontier with the edges, an
aggregation to the smallest key, and an anti-join with what was visited. Only row counts
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.operators.components import connected_components
from tarnfall.operators.relational import numbered
from tarnfall.sources.tables import stage


def both_ways(edges: DataFrame) -> DataFrame:
    """``id, a, b``: every edge from both of its ends."""
    e = edges.select("id", F.col("source").alias("a"), F.col("target").alias("b"))
    return e.unionByName(e.select("id", F.col("b").alias("a"), F.col("a").alias("b")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, most_nodes: int | None = None, node_filter: DataFrame | None = None) -> DataFrame:
    """``seed, node, hop``: nodes within ``depth`` steps of each seed, with the fewest steps; seeds at 0.

    ``edges`` has ``a, b``, directed; ``seeds`` has ``seed``. Nodes outside
    ``node_filter`` are neither returned nor passed. At ``most_nodes`` a seed, the rest of
    the hop and all later ones are left out, in the order of hop, then node.
    """
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    if node_filter is not None:
        seen = seen.join(node_filter, "node", "left_semi")
    seen = stage(seen)
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select("seed", F.col("node").alias("a")).join(edges, "a").select("seed", F.col("b").alias("node")).distinct()
        if node_filter is not None:
            step = step.join(node_filter, "node", "left_semi")
        new = step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if most_nodes is not None:
            have = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("have"))
            new = new.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).join(have, "seed").filter(F.col("_n") + F.col("have") <= most_nodes).select("seed", "node", "hop")
        frontier = stage(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column ``node``), each once."""
    a, b = nodes.select(F.col("node").alias("source")).distinct(), nodes.select(F.col("node").alias("target")).distinct()
    return edges.join(a, "source", "left_semi").join(b, "target", "left_semi").select("id", "source", "target").distinct()


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``gone`` (column ``id``) and their edges."""
    g = gone.select("id")
    cut = edges.join(g.withColumnRenamed("id", "source"), "source", "left_anti").join(g.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(g, "id", "left_anti"), cut.select(edges.columns)


def whole_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def traverse(
    nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, direction: str = "both", edge_types: list[str] | None = None, min_weight: float | None = None,
    node_types: list[str] | None = None, time_range: tuple[str, str] | None = None, max_nodes: int | None = 1000, max_edges: int | None = 5000,
) -> DataFrame:
    """``node, hop``: what a filtered walk from one node reaches.

    ``nodes`` has ``id, node_type, properties``, ``edges`` has ``id, source, target,
    edge_type, properties``, the properties as JSON. ``direction`` is outgoing, incoming
    or both. A missing confidence counts as 0, a missing created_time passes; times are
    compared as texts. A node that fails a filter is neither returned nor passed; a root
    that does gives nothing, one that isn't there is an error.

    Both limits stop the walk and keep what was found, in the order of hop, node, edge:
    edges count before any filter, and the walk ends with the first beyond ``max_edges``;
    nodes are counted after each is taken, so at least one besides the root is. None
    sets no limit, and then nothing is put in order.
    """
    of = lambda c, key: F.get_json_object(c, f"$.{key}")
    there = nodes.groupBy(F.col("id").alias("node")).agg(F.max("node_type").alias("node_type"), F.max(of("properties", "created_time")).alias("t"))
    good = F.lit(True) if node_types is None else F.col("node_type").isin(node_types)
    if time_range is not None:
        good = good & (F.col("t").isNull() | F.col("t").between(*time_range))
    start = there.filter(F.col("node") == root).select(good.alias("good")).first()
    if start is None:
        raise ValueError(f"there is no node {root!r}")
    there = there.filter(good).select("node")
    wanted = F.lit(True) if edge_types is None else F.col("edge_type").isin(edge_types)
    if min_weight is not None:
        wanted = wanted & (F.coalesce(of("properties", "confidence").cast("double"), F.lit(0.0)) >= min_weight)
    plain = edges.select("id", "source", "target", F.coalesce(wanted, F.lit(False)).alias("wanted")).distinct()
    ends = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(direction != "incoming").alias("way")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(direction != "outgoing").alias("way")))
    both = plain.select("id", "wanted", F.inline(ends)).filter("a <> b or way").filter("a is not null and b is not null")
    seen = stage(nodes.sparkSession.createDataFrame([(root, 0)] if start["good"] else [], "node string, hop int"))
    frontier, passed, count = seen, 0, 1
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("a")).join(both, "a")
        if max_edges is not None:
            step = stage(step.orderBy("a", "id").limit(max_edges - passed + 1))
            n = step.count()
            last = n > max_edges - passed
            step = step.orderBy("a", "id").limit(max_edges - passed)
            passed += n
        kept = step.filter("wanted and way").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "id")).alias("first"))
        kept = kept.join(there, "node", "left_semi").join(seen, "node", "left_anti")
        if max_nodes is not None:
            kept = kept.orderBy("first").limit(max(1, max_nodes - count))
        frontier = stage(kept.select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
        n = frontier.count()
        count += n
        if not n or (max_edges is not None and last) or (max_nodes is not None and count >= max_nodes):
            break
    return seen


def topological_levels(edges: DataFrame) -> DataFrame:
    """``node, level``: 0 without predecessors, else one more than the highest; -1 on or behind a cycle.

    ``edges`` has ``a, b``: a comes before b. A node with one predecessor is one level
    behind it, so such nodes are first led back to the nearest node of another kind, by
    doubling the way in every round; then those without predecessors are taken off, round
    by round, over the edges between what is left. A tree takes a logarithmic number of
    rounds, another graph besides them one for each node with several predecessors on its
    longest way.
    """
    edges = stage(edges.filter("a is not null and b is not null").select("a", "b").distinct())
    into = edges.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.max("a").alias("up"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    state = stage(nodes.join(into, F.col("node") == F.col("b"), "left").select("node", F.coalesce("c", F.lit(0)).alias("pending"), F.when(F.col("c") == 1, F.col("up")).alias("up")))
    total, inner = state.agg(F.count(F.lit(1)), F.count("up")).first()
    single = state.filter("up is not null").select("node", "up", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("there"))
    rounds = inner.bit_length() + 1  # the longest way is led back by then, but on a cycle
    for _ in range(rounds if total else 0):
        on = single.select(F.col("node").alias("k"), F.col("up").alias("u"), F.col("dist").alias("d"), F.col("there").alias("t"))
        step = single.filter("not there").join(on, F.col("up") == F.col("k"), "left")
        more = F.col("k").isNotNull()
        step = step.select("node", F.when(more, F.col("u")).otherwise(F.col("up")).alias("up"), (F.col("dist") + F.when(more, F.col("d")).otherwise(0)).alias("dist"), (~more | F.col("t")).alias("there"))
        single = stage(single.filter("there").unionByName(step))
        if single.filter("not there").isEmpty():
            break
    led = single.filter("there").select("node", "up", "dist")
    left = state.filter("up is null").select("node", "pending", F.lit(0).cast("long").alias("level"))
    several = edges.join(state.filter("pending > 1").select(F.col("node").alias("b")), "b", "left_semi")
    # an edge from a node that is led back comes from where it is led to
    ways = several.join(led.select(F.col("node").alias("a"), "up", "dist"), "a", "left").select(F.coalesce("up", "a").alias("a"), "b", (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
    ways = stage(ways)
    left, done = stage(left), None
    while True:
        free = left.filter("pending = 0").select("node", "level")
        done = free if done is None else done.unionByName(free)
        sent = free.join(ways, F.col("node") == F.col("a")).groupBy(F.col("b").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.max(F.col("level") + F.col("dist")).alias("l"))
        after = left.filter("pending > 0").join(sent, F.col("node") == F.col("k"), "left")
        left = stage(after.select("node", (F.col("pending") - F.coalesce("c", F.lit(0))).alias("pending"), F.greatest("level", F.coalesce("l", F.lit(0))).alias("level")))
        if left.filter("pending = 0").isEmpty():
            break
    behind = led.join(done.select(F.col("node").alias("up"), "level"), "up").select("node", (F.col("level") + F.col("dist")).alias("level"))
    known = done.unionByName(behind)
    return nodes.join(known, "node", "left").select("node", F.coalesce("level", F.lit(-1)).cast("int").alias("level"))


def topological_order(edges: DataFrame) -> DataFrame:
    """``node, level, position``: every node behind its predecessors; those of cycles come last, by name."""
    levels = topological_levels(edges)
    return numbered(levels, [F.col("level") < 0, F.col("level"), F.col("node")], "position")


def cycles(edges: DataFrame) -> DataFrame:
    """``node, cycle``: the nodes on cycles, or on a way between two, with the smallest node of their part.

    Peeled from both sides: what has no predecessor left goes, then what has no successor.
    """
    own = edges.filter("a is not null and b is not null").select("a", "b").distinct()
    for forward in (True, False):
        way = own if forward else own.select(F.col("b").alias("a"), F.col("a").alias("b"))
        stuck = stage(topological_levels(way).filter("level < 0").select("node"))
        own = own.join(stuck.withColumnRenamed("node", "a"), "a", "left_semi").join(stuck.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    return connected_components(own).select("node", F.col("component").alias("cycle"))


def ready(tasks: DataFrame, edges: DataFrame, pending: Column, done: Column) -> DataFrame:
    """Pending tasks of which every predecessor is done; ``tasks`` has ``id``, ``edges`` ``a, b``."""
    open_ = tasks.filter(~done).select(F.col("id").alias("a"))
    waiting = edges.join(open_, "a", "left_semi").select(F.col("b").alias("id")).distinct()
    return tasks.filter(pending).join(waiting, "id", "left_anti")
