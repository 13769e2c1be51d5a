"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Each round takes off the nodes that have no children left and sends their subtree sizes
to their parents, pre-aggregated per parent, so a parent of a third of all nodes gets
one row a task. The same round shortens chains: of the nodes with a single child, which
isn't a leaf, about a third, no two of them neighbours, hand that child over to their
own parent. So every round takes off a constant part of what is left, whatever the depth
of the trees, and the number of rounds is logarithmic. What is left when nothing can be
taken off are the nodes on cycles. In reverse order every node takes root, depth and path
from the node that was its parent when it went, which is always resolved by then, and one
taken out of a chain its size from the child that it handed over.

All rounds are joins of tables; no task and not the driver ever holds a part of the
tree, and only two counts a round go to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.tables import stage


def parent_links(df: DataFrame, key: str, parent: str, version: Column) -> DataFrame:
    """One row per node: ``id, parent, up``; ``up`` is the parent if it has a row itself.

    Of several rows of one key the one with the greatest ``version`` holds (ties: the
    greater parent). Null keys are left out. A parent that is null or empty is none.
    """
    own = F.col(parent).cast("string")
    rows = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("id"))
        .agg(F.max(F.struct(version.alias("v"), F.when(own != "", own).alias("p")))["p"].alias("parent"))
    )
    there = rows.select(F.col("id").alias("up"))
    return rows.join(there.hint("merge"), rows.parent == there.up, "left").select("id", "parent", "up")


def _lot(node: str, number: int) -> Column:
    """An order of the nodes, another one in every round."""
    return F.struct(F.xxhash64(F.lit(number), node), F.col(node))


def _round(state: DataFrame, number: int, with_path: bool) -> DataFrame:
    """What becomes of the nodes: ``gone`` is 1 for leaves, 2 for nodes taken out of a chain, else null.

    ``state`` has ``id, up, dist, via, carry, size, pending``: the present parent, the steps
    to it and the nodes between, what the nodes between hold of side branches, the size of
    what was taken off below the node, itself included, and the children that are left.
    """
    leaf = F.col("pending") == 0
    below = (
        state.filter("up is not null")
        .groupBy(F.col("up").alias("k"))
        .agg(
            F.sum(F.when(leaf, F.col("size") + F.col("carry"))).alias("got"),
            F.count(F.when(leaf, 1)).alias("lost"),
            F.max(F.struct("id", F.col("pending").alias("p"), F.col("carry").alias("c"))).alias("child"),
        )
    )
    # of a chain, a node goes if its lot is above those of its parent and of its only child
    first = (_lot("id", number) > _lot("up", number)) & (_lot("id", number) > _lot("child.id", number))
    goes = (F.col("pending") == 1) & F.col("up").isNotNull() & (F.col("child.p") > 0) & (F.col("up") != F.col("child.id")) & first
    known = state.join(below.hint("merge"), F.col("id") == F.col("k"), "left").withColumn("gone", F.when(leaf, 1).when(goes, 2))
    known = known.select(
        "id", "up", "dist", "via", "carry", (F.col("size") + F.coalesce("got", F.lit(0))).alias("size"), (F.col("pending") - F.coalesce("lost", F.lit(0))).alias("pending"),
        "gone", F.when(F.col("gone") == 2, F.col("child.id")).alias("handed"), F.when(F.col("gone") == 2, F.col("child.c")).alias("handed_carry"),
    )
    out = known.filter("gone = 2").select(F.col("handed").alias("h"), F.col("id").alias("mid"), F.col("up").alias("mid_up"), F.col("dist").alias("mid_dist"), F.col("via").alias("mid_via"), F.col("carry").alias("mid_carry"), F.col("size").alias("mid_size"))
    moved = known.join(out.hint("merge"), F.col("id") == F.col("h"), "left")
    new = F.col("mid").isNotNull()
    via = F.when(new, F.concat("mid_via", F.array("mid"), "via")).otherwise(F.col("via")) if with_path else F.col("via")
    return moved.select(
        "id", F.when(new, F.col("mid_up")).otherwise(F.col("up")).alias("up"), (F.col("dist") + F.when(new, F.col("mid_dist")).otherwise(0)).alias("dist"), via.alias("via"),
        (F.col("carry") + F.when(new, F.col("mid_size") + F.col("mid_carry")).otherwise(0)).alias("carry"), "size", "pending", "gone", "handed", "handed_carry",
    )


def resolve(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Root, depth, subtree size and, if asked for, the path of every node.

    ``links`` as of :func:`parent_links`. Returns ``id, parent, root_id, depth,
    subtree_size, path``: the root is the topmost existing ancestor, the node itself at
    depth 0; ``path`` lists the ids from root to node. Nodes on a cycle or below one have
    root '' and depth -1, no path, and a null size on a cycle; below one the size is right.
    An empty table gives no rows.
    """
    tree = stage(links)
    children = tree.filter("up is not null").groupBy(F.col("up").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    state = tree.join(children.hint("merge"), F.col("id") == F.col("k"), "left").select(
        "id", "up", F.lit(1).cast("long").alias("dist"), F.array().cast("array<string>").alias("via"), F.lit(0).cast("long").alias("carry"), F.lit(1).cast("long").alias("size"), F.coalesce("c", F.lit(0)).alias("pending")
    )
    rounds: list[DataFrame] = []
    state = stage(state)
    while True:
        after = stage(_round(state, len(rounds), with_path))
        n, gone, leaves = after.agg(F.count(F.lit(1)), F.count("gone"), F.count(F.when(F.col("gone") == 1, 1))).first()
        if not leaves:
            # only cycles are left: what hangs between their nodes isn't a tree's
            done = after.select("id", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("array<string>").alias("path"))
            break
        rounds.append(after.filter("gone is not null"))
        state = after.filter("gone is null").drop("gone", "handed", "handed_carry")
        if n == gone:
            done = None
            break
    for peeled in reversed(rounds):
        top = F.col("up").isNull()
        if done is None:  # the last round took off nothing but roots
            own = peeled.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), "size", F.when(F.lit(with_path), F.array("id")).alias("path"))
            done = stage(own)
            continue
        above = done.select(F.col("id").alias("k"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path").alias("p")).hint("merge")
        child = done.select(F.col("id").alias("h"), F.col("size").alias("s")).hint("merge")
        path = F.when(top, F.array("id")).when(F.col("d") >= 0, F.concat("p", "via", F.array("id"))) if with_path else F.lit(None).cast("array<string>")
        own = (
            peeled.join(above, F.col("up") == F.col("k"), "left")
            .join(child, F.col("handed") == F.col("h"), "left")
            .select(
                "id",
                F.when(top, F.col("id")).otherwise(F.col("r")).alias("root"),
                F.when(top, F.lit(0)).when(F.col("d") < 0, F.lit(-1)).otherwise(F.col("d") + F.col("dist")).cast("long").alias("depth"),
                F.when(F.col("gone") == 1, F.col("size")).otherwise(F.col("size") + F.col("handed_carry") + F.col("s")).alias("size"),
                path.alias("path"),
            )
        )
        done = done.unionByName(stage(own))
    parents = tree.select("id", "parent")
    return done.join(parents.hint("merge"), "id").select("id", "parent", F.col("root").alias("root_id"), "depth", F.col("size").alias("subtree_size"), "path")


def descendants(resolved: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it: ``ancestor_id, descendant_id, distance``.

    Each path, already known, is taken apart where it lies: no join, no list of a node's
    descendants in one row, which for a root could be a third of the table.
    """
    n = F.size("path")
    return (
        resolved.filter("path is not null")
        .select(F.col("id").alias("descendant_id"), n.alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
        .filter("pos < n - 1")
        .select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))
    )
