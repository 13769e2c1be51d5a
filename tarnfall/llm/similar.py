"""The k most similar vectors of every vector: inverted lists with an adaptive dimension scan.

Vectors fall into about as many lists as the square root of their number, around
centroids that are fitted per model in two levels: a few on one bounded sample, then those
of each cell of these on the sample's rows in it, each cell in a task of its own. Every
vector is in a list. A query looks into the ``probes`` lists nearest to it, the nearest
first, and each step tightens the bound for the next. Inside a list all vectors are
rotated by one random rotation and held in blocks of columns: the distance over the first
block, times dimensions over block, estimates the whole distance, and a hypothesis test
against the query's present k-th best abandons most candidates there; the others get the
next block, and so on, as a matrix while many are left and one by one then. What survives
is compared exactly, in double precision on the stored values.

Lists are packed into shards of about ``SHARD`` vectors, by estimated sizes, and a list
that is larger by itself is dealt over several shards, so a dense region that holds a
third of all rows makes more tasks, not larger ones. Queries stream through a shard in
batches, and shards that many queries want are copied for slices of the queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.sources.tables import stage

#: Rows of one model on which the upper centroids are fitted, and rows a list in the sample for the lower ones.
SAMPLE, ROWS_A_LIST = 20_000, 100
PROBES = 40
SHARD = 20_000
QUERIES = 20_000
BLOCK = 16
#: Part of the candidates up to which the next block is taken one by one.
FEW = 0.08
#: Width of the test: a candidate goes if its estimate exceeds the bound by 1 + EPSILON / sqrt(dimensions seen).
EPSILON = 2.1


def usable_vectors(df: DataFrame, hash_column: str = "content_hash", model_column: str = "model", vector_column: str = "embedding", dim_column: str = "dim", time_column: str = "ts") -> DataFrame:
    """``model, hash, vector``: the latest row of each pair, if its vector is usable.

    Usable is a vector that is there, has ``dim`` elements, all finite, and isn't all
    zero. Of rows with one time the greater vector holds. Null hashes or models are left out.
    """
    latest = (
        df.filter(F.col(hash_column).isNotNull() & F.col(model_column).isNotNull())
        .groupBy(F.col(model_column).alias("model"), F.col(hash_column).alias("hash"))
        .agg(F.max(F.struct(F.col(time_column).alias("t"), F.col(dim_column).alias("d"), F.col(vector_column).alias("vector"))).alias("x"))
        .select("model", "hash", "x.d", "x.vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return latest.filter((F.size("vector") == F.col("d")) & finite & F.exists("vector", lambda x: x != 0)).select("model", "hash", "vector")


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centroids(units: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread seeds; deterministic for a given order of rows."""
    rng = np.random.default_rng(7)
    centroids = units[rng.choice(len(units), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(units[k : k + 4096] @ centroids.T).argmax(1) for k in range(0, len(units), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-9
        sums[empty] = units[rng.choice(len(units), empty.sum())]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for every call."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class _Model:
    """Centroids of one model, and which shards and query slices its lists are in."""

    def __init__(self, first: int, centroids: np.ndarray, counts: np.ndarray, sample: np.ndarray, rows: int, probes: int):
        self.centroids, self.probes = centroids.astype(np.float32), min(probes, len(centroids))
        near = self.nearest(sample)
        scale = rows / len(sample)
        sizes = counts * (rows / counts.sum())
        axis = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0]
        shard, used, self.parts = 0, 0.0, {}
        for k in np.argsort(centroids @ axis, kind="stable").tolist():  # lists that lie together share a shard
            pieces = max(1, round(sizes[k] / SHARD))
            if used and used + sizes[k] / pieces > SHARD:
                shard, used = shard + 1, 0.0
            self.parts[k] = list(range(shard, shard + pieces))
            shard, used = shard + pieces - 1, used + sizes[k] if pieces == 1 else SHARD
        self.shards = shard + 1
        self.reach = np.zeros((len(centroids), self.shards), dtype=bool)  # list by shard
        for k, own in self.parts.items():
            self.reach[k, own] = True
        wanted = np.zeros(self.shards)
        for row in near:
            wanted += self.reach[row].any(0)
        self.slices = np.maximum(1, np.ceil(wanted * scale / QUERIES)).astype(int)
        self.first = first + np.concatenate([[0], np.cumsum(self.slices)])  # the number of each shard's first part

    def nearest(self, units: np.ndarray) -> np.ndarray:
        close = units.astype(np.float32) @ self.centroids.T
        if self.probes == close.shape[1]:
            return np.argsort(-close, axis=1, kind="stable")
        some = np.argpartition(-close, self.probes - 1, axis=1)[:, : self.probes]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable"), 1)

    def part(self, shard: int, slice_: int) -> int:
        return int(self.first[shard]) + slice_


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lot(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _route(models):
    """Rows (key, hash, vector) to their parts: once as data (kind 0), once as query (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), dtype=object)
            for key in dict.fromkeys(keys.tolist()):
                m = models.value[key]
                rows = b.filter(pa.array(keys == key))
                near = m.nearest(_units(_vectors(rows.column(2))))
                lot = [_lot(h) for h in rows.column(1).to_pylist()]
                at, part, kind = [], [], []
                for row, (own, salt) in enumerate(zip(near, lot)):
                    shards = m.parts[int(own[0])]
                    shard = shards[salt % len(shards)]
                    for s in range(m.slices[shard]):
                        at.append(row)
                        part.append(m.part(shard, s))
                        kind.append(0)
                    for shard in np.flatnonzero(m.reach[own].any(0)).tolist():
                        at.append(row)
                        part.append(m.part(shard, salt // 7 % int(m.slices[shard])))
                        kind.append(1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), *(rows.column(k).take(pa.array(at, pa.int64())) for k in range(3))], names=["part", "kind", "key", "hash", "vector"])

    return run


class Shard:
    """The vectors of one shard, ready to be searched."""

    def __init__(self, model: _Model, hashes: list[str], vectors: np.ndarray, k: int):
        self.model, self.k = model, k
        units = _units(vectors)
        own = model.nearest(units)[:, 0]
        order = np.argsort(own, kind="stable")
        self.hashes = np.array(hashes, dtype=object)[order]
        self.units = units[order]
        self.rotated = self.units.astype(np.float32) @ rotation(vectors.shape[1])
        self.rank = np.argsort(np.argsort(self.hashes, kind="stable"), kind="stable")
        lists, starts = np.unique(own[order], return_index=True)
        self.span = dict(zip(lists.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))

    def search(self, hashes: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, data row, similarity) of each query's k best in this shard, ties to the smaller hash."""
        units = _units(vectors)
        rotated = units.astype(np.float32) @ rotation(vectors.shape[1])
        near = self.model.nearest(units)
        n, k = len(units), self.k
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        kth = np.full(n, -1.0)
        own = np.array(hashes, dtype=object)
        here = np.isin(near, list(self.span))
        place = np.where(here, here.cumsum(1), 0)  # 1 for the nearest list that is here
        steps = [(1, 1), (2, 4), (5, 16), (17, here.shape[1])]
        for mask in [(place >= a) & (place <= b) for a, b in steps if a <= here.shape[1]]:  # near lists set good bounds for the others
            rows, columns = np.nonzero(mask)
            lists = near[rows, columns]
            order = np.argsort(lists, kind="stable")
            rows, lists = rows[order], lists[order]
            for list_, q in _runs(lists, rows):
                lo, hi = self.span[list_]
                for at in range(0, len(q), 4096):
                    found = self._scan(rotated, units, kth, q[at : at + 4096], lo, hi)
                    best = tuple(map(np.concatenate, zip(best, found)))
            keep = own[best[0]] != self.hashes[best[1]]
            best = tuple(x[keep] for x in best)
            order = np.lexsort((self.rank[best[1]], -best[2], best[0]))
            best = tuple(x[order] for x in best)
            nth = np.arange(len(best[0])) - np.searchsorted(best[0], best[0], "left")
            best = tuple(x[nth < k] for x in best)
            last = nth[nth < k] == k - 1
            kth[best[0][last]] = best[2][last]
        return best

    def _scan(self, rotated: np.ndarray, units: np.ndarray, kth: np.ndarray, q: np.ndarray, lo: int, hi: int):
        data, mine, dim = self.rotated[lo:hi], rotated[q], rotated.shape[1]
        bound = (2 - 2 * (kth[q] - 2e-6)).astype(np.float32)

        def limit(seen: int) -> np.ndarray:
            return bound * (seen / dim * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dim else 1) + 1e-5

        seen, partial = 0, np.zeros((len(q), hi - lo), dtype=np.float32)
        while seen < dim:
            a, b = mine[:, seen : seen + BLOCK], data[:, seen : seen + BLOCK]
            partial += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
            seen = min(seen + BLOCK, dim)
            left = partial <= limit(seen)[:, None]
            if left.mean() <= FEW:
                break
            partial[~left] = np.inf
        qi, xi = np.nonzero(left)
        partial = partial[qi, xi]
        for seen in range(seen, dim, BLOCK):
            gap = mine[qi, seen : seen + BLOCK] - data[xi, seen : seen + BLOCK]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            keep = partial <= limit(min(seen + BLOCK, dim))[qi]
            qi, xi, partial = qi[keep], xi[keep], partial[keep]
        similarity = np.round(np.einsum("ij,ij->i", units[q[qi]], self.units[lo + xi]), 6)
        return q[qi], lo + xi, similarity


def _runs(lists: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(lists):
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(lists[a]), rows[a:b]


_FOUND = "key string, hash string, other string, similarity double"


def _search(models, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, data = None, None, []
        for b in batches:
            parts = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
            for lo, hi in zip(cuts, cuts[1:]):
                rows = b.slice(lo, hi - lo)
                if parts[lo] != part:
                    part, shard, data = int(parts[lo]), None, []
                kinds = rows.column(1).to_numpy()
                split = int((kinds == 0).sum())  # data come first
                if split:
                    data.append(rows.slice(0, split))
                queries = rows.slice(split)
                if not queries.num_rows or not data and shard is None:
                    continue  # no data in this part: nothing to find here
                key = queries.column(2)[0].as_py()
                if shard is None:
                    whole = pa.Table.from_batches(data).combine_chunks().to_batches()[0]
                    shard, data = Shard(models.value[key], whole.column(3).to_pylist(), _vectors(whole.column(4)), k), []
                hashes = queries.column(3).to_pylist()
                for at in range(0, len(hashes), 2048):
                    own = hashes[at : at + 2048]
                    q, x, similarity = shard.search(own, _vectors(queries.slice(at, len(own)).column(4)))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(q), pa.string()), pa.array([own[i] for i in q.tolist()], pa.string()), pa.array(shard.hashes[x].tolist(), pa.string()), pa.array(similarity)], names=["key", "hash", "other", "similarity"])

    return run


def most_similar(vectors: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
    """``model, hash, other, similarity, place``: the k most similar other vectors of each.

    ``vectors`` as of :func:`usable_vectors`. Similarity is the cosine rounded to six
    decimals; ties go to the smaller hash. Vectors of different lengths are never
    compared. A model with fewer than k + 1 vectors gives fewer rows; an empty table none.
    Recall against brute force depends on ``probes``; it is 1 where a model has no more lists.
    """
    spark = vectors.sparkSession
    keyed = stage(vectors.select(F.concat_ws("\x1f", "model", F.size("vector").cast("string")).alias("key"), "hash", "vector"))
    counts = {r[0]: r[1] for r in keyed.groupBy("key").agg(F.count(F.lit(1))).collect()}  # a row per model
    if not counts:
        return spark.createDataFrame([], "model string, hash string, other string, similarity double, place int")
    size = F.broadcast(spark.createDataFrame(list(counts.items()), "key string, n long"))
    place = F.pmod(F.xxhash64("hash"), F.col("n"))
    sample = stage(keyed.join(size, "key").withColumn("place", place).filter(F.col("place") < F.greatest(F.lit(float(SAMPLE)), ROWS_A_LIST * F.sqrt("n"))))

    def fit_upper(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hash")
        units = _units(np.stack(pdf["vector"].to_list()).astype(np.float64))
        cells = min(max(1, round(int(pdf["n"].iloc[0]) ** 0.25)), len(units))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "dim": [units.shape[1]], "centroids": [fit_centroids(units, cells).ravel().tolist()]})

    fitted = sample.filter(F.col("place") < SAMPLE).groupBy("key").applyInPandas(fit_upper, "key string, dim int, centroids array<double>").collect()  # n ** 0.25 centroids a model
    upper = spark.sparkContext.broadcast({r[0]: np.array(r[2]).reshape(-1, r[1]) for r in fitted})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cell"] = 0
            for key in pdf["key"].unique():
                own = pdf["key"] == key
                pdf.loc[own, "cell"] = (_units(np.stack(pdf.loc[own, "vector"].to_list()).astype(np.float64)) @ upper.value[key].T).argmax(1)
            yield pdf

    def fit_lower(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hash")
        key, n = pdf["key"].iloc[0], int(pdf["n"].iloc[0])
        units = _units(np.stack(pdf["vector"].to_list()).astype(np.float64))
        rows = min(n, max(SAMPLE, ROWS_A_LIST * n**0.5))  # in the whole sample, about
        centroids = fit_centroids(units, min(max(1, round(n**0.5 * len(units) / rows)), len(units)))
        counts = np.bincount((units @ centroids.T).argmax(1), minlength=len(centroids))
        kept = units[:: max(1, round(rows / 2000))]
        return pd.DataFrame({"key": [key], "cell": [pdf["cell"].iloc[0]], "centroids": [centroids.ravel().tolist()], "counts": [counts.tolist()], "sample": [kept.ravel().tolist()]})

    fitted = sample.mapInPandas(cells, "key string, hash string, vector array<float>, n long, place long, cell int").groupBy("key", "cell").applyInPandas(fit_lower, "key string, cell int, centroids array<double>, counts array<long>, sample array<double>").collect()  # n ** 0.5 centroids a model
    lower: dict = {}
    for r in sorted(fitted, key=lambda r: (r[0], r[1])):
        lower.setdefault(r[0], []).append([np.array(x) for x in r[2:]])
    found, first = {}, 0
    for key, cells_ in lower.items():
        dim = upper.value[key].shape[1]
        centroids, number, kept = (np.concatenate(x) for x in zip(*cells_))
        found[key] = _Model(first, centroids.reshape(-1, dim), number, kept.reshape(-1, dim), counts[key], probes)
        first = int(found[key].first[-1])
    models = spark.sparkContext.broadcast(found)
    parts = sum(int(m.slices.sum()) for m in models.value.values())
    routed = keyed.mapInArrow(_route(models), "part long, kind int, key string, hash string, vector array<float>")
    found = routed.repartition(max(2, min(parts, 10_000)), "part").sortWithinPartitions("part", "kind").mapInArrow(_search(models, k), _FOUND)
    order = Window.partitionBy("key", "hash").orderBy(F.desc("similarity"), "other")
    return (
        found.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .select(F.substring_index("key", "\x1f", 1).alias("model"), "hash", "other", "similarity", "place")
    )
