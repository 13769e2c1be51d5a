"""Connected components of an edge list, in a logarithmic number of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.tables import stage

#: Edges that a task joins up by itself at a time.
CHUNK = 200_000


def _forests(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (u, v), a chunk at a time: each node with the smallest node that the chunk links it to, which may be itself."""
        up: dict = {}
        size = 0

        def top(x):
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def rows() -> pa.RecordBatch:
            found = [(top(x), x) for x in up]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["u", "v"])

        kind = pa.string()
        for b in batches:
            kind = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = top(up.setdefault(u, u)), top(up.setdefault(v, v))
                if x != y:
                    up[max(x, y)] = min(x, y)
            size += b.num_rows
            if size >= chunk:
                yield rows()
                up, size = {}, 0
        if up:
            yield rows()

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Edges are first joined up chunk by chunk, which leaves one for each node of a chunk.
    If one chunk can hold all that is left, joining that up ends it. Else "each node links
    its larger neighbours to its smallest one" alternates with the same on the smaller
    side until no edge moves. A hub's neighbours are never gathered: only their minimum
    is, which is pre-aggregated. Self-links and repeated edges are fine; null ends are
    left out; an empty edge list gives no rows.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    kind = e.schema["u"].dataType.simpleString()
    joined = lambda x: x.mapInArrow(_forests(CHUNK), f"u {kind}, v {kind}")
    own = stage(joined(e).distinct())
    if own.count() <= CHUNK:
        return stage(joined(own.coalesce(1))).select(F.col("v").alias("node"), F.col("u").alias("component"))
    e = own.filter("u <> v")
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.select("u", "v").union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("x"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("y"))
        e = stage(small.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.unionByName(own.filter("u = v")).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
