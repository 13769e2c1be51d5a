"""Chunking, exact vector search, BM25 full text and rank fusion."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tarnfall.sources.tables import stage


def chunk_spans(text: str, separator: str = "\n\n", size: int = 500, overlap: int = 50) -> list[tuple[int, int]]:
    """Paragraphs merged up to ``size`` characters; a longer one slides with ``overlap``. Spans are exact."""
    spans, at, start, end = [], 0, None, 0
    parts = text.split(separator) if separator else [text]
    for part in parts:
        lo, hi = at, at + len(part)
        at = hi + len(separator)
        if not part.strip():
            continue
        if start is not None and hi - start > size:
            spans.append((start, end))
            start = None
        if hi - lo > size:
            k = lo
            while True:
                spans.append((k, min(k + size, hi)))
                if k + size >= hi:
                    break
                k += size - overlap
            continue
        start, end = lo if start is None else start, hi
    if start is not None:
        spans.append((start, end))
    return spans


def chunks(df: DataFrame, doc: str, text: str, separator: str = "\n\n", size: int = 500, overlap: int = 50) -> DataFrame:
    """``id, doc_id, chunk_idx, content, start_offset, end_offset``; blank and null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (lo, hi) in enumerate(chunk_spans(t or "", separator, size, overlap)):
                    for column, x in zip(out, (f"{d}#{k}", d, k, t[lo:hi], lo, hi)):
                        column.append(x)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "doc_id", "chunk_idx", "content", "start_offset", "end_offset"])

    return df.select(F.col(doc).cast("string"), F.col(text)).mapInArrow(run, "id string, doc_id string, chunk_idx long, content string, start_offset long, end_offset long")


#: Most numbers of all query vectors together that are sent to every task, 8 bytes each.
MAX_QUERY_NUMBERS = 20_000_000


def top_k_vectors(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """``query, id, score, place``: the k vectors most similar to each query by cosine, exactly.

    The query side is measured first: blocks of at most ``MAX_QUERY_NUMBERS`` numbers are
    sent to the tasks one after the other, each scored against all vectors as a product
    of matrices, of which a task keeps k rows a query and batch before anything is
    shuffled. Null vectors are left out; zero vectors and unequal lengths score 0. Ties
    go to the smaller id.
    """
    q = queries.select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null")
    x = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    schema = f"query {q.schema['query'].dataType.simpleString()}, id {x.schema['id'].dataType.simpleString()}, score double"
    numbers = q.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()[0]
    blocks = numbers // MAX_QUERY_NUMBERS + 1
    found = None
    for block in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) if blocks > 1 else q
        part = x.mapInArrow(_scored(q.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()]), to_arrow_type(q.schema["query"].dataType), k), schema)  # a bounded block
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _units(rows: list, n: int) -> np.ndarray:
    out = np.array([r for r in rows if len(r) == n], dtype=np.float64).reshape(-1, n)
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _scored(queries, kind: pa.DataType, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        names = [a for a, _ in asked]
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            scores = np.zeros((len(asked), len(ids)))
            for n in {len(r) for r in rows} & {len(v) for _, v in asked} - {0}:
                qi, xi = np.array([i for i, (_, v) in enumerate(asked) if len(v) == n]), np.array([i for i, r in enumerate(rows) if len(r) == n])
                scores[np.ix_(qi, xi)] = _units([v for _, v in asked], n) @ _units(rows, n).T
            scores = np.round(scores, 6) + 0.0
            if not scores.size:
                continue
            rank = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"), kind="stable")
            best = np.lexsort((np.broadcast_to(rank, scores.shape), -scores), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in range(len(asked)) for _ in range(best.shape[1])], kind), pa.array([ids[j] for j in best.ravel().tolist()], b.schema.field(0).type), pa.array(np.take_along_axis(scores, best, 1).ravel())],
                names=["query", "id", "score"],
            )

    return run


def product(a: str, b: str) -> Column:
    """The sum of the products of two arrays' numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector: str) -> Column:
    """A vector at unit length; a zero vector as it is."""
    norm = F.sqrt(product(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.col(vector).cast("array<double>"))


def nearest_in_layers(vectors: DataFrame, layer: str, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """``layer, query, id, distance``: of every layer the k vectors nearest to each query by Euclidean distance, ties to the smaller id.

    As :func:`top_k_vectors`, the query side is measured and refused above ``MAX_QUERY_NUMBERS``.
    """
    q = queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("_q"))
    numbers = q.agg(F.coalesce(F.sum(F.size("_q").cast("long")), F.lit(0))).first()[0]
    if numbers > MAX_QUERY_NUMBERS:
        raise ValueError(f"the queries hold {numbers} numbers, more than MAX_QUERY_NUMBERS = {MAX_QUERY_NUMBERS}; split them")
    gap = F.zip_with("_v", "_q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    rows = vectors.select(F.col(layer).alias("layer"), F.col(key).alias("id"), F.col(vector).alias("_v")).join(F.broadcast(q), F.size("_v") == F.size("_q"))
    scored = rows.select("layer", "query", "id", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)), 5).alias("distance"))
    w = Window.partitionBy("layer", "query").orderBy("distance", "id")
    return scored.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case; a CJK run is one token."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of documents that hold a query token. Statistics are those of all documents."""
    words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).filter("t is not null").withColumn("n", F.size("t"))
    whole = words.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    hits = words.select("id", "n", F.explode(F.filter("t", lambda x: x.isin(*query))).alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # a row per query token; one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return x.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def fuse(channels: list[DataFrame], k: int, constant: int = 60, width: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of frames ``id, score``: sum of 1 / (constant + rank), ties to the smaller id.

    Of each channel the best ``width`` rows are ranked, max(50, 5k) if not given, so no
    task ever ranks more.
    """
    n = max(50, 5 * k) if width is None else width
    best = [c.orderBy(F.desc("score"), "id").limit(n) for c in channels]
    ranked = [c.select("id", (1 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("part")) for c in best]  # n rows
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy("id").agg(F.round(F.sum("part"), 8).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(vector_scores: DataFrame, text_scores: DataFrame, k: int) -> DataFrame:
    """Fusion of the best max(50, 5k) of both channels."""
    return fuse([vector_scores, text_scores], k)


def backend_for(rows: Column) -> Column:
    """Exact search below a thousand vectors, lists from there on."""
    return F.when(rows < 1000, "exact").otherwise("lists")


# Rows below which a tier holds, links a node, candidates when building and when searching.
TIERS = ((1_000, 8, 100, 50), (10_000, 16, 200, 100), (100_000, 32, 400, 200), (None, 48, 500, 300))


def index_parameters(rows: Column) -> Column:
    """``m, ef_construction, ef_search`` that suit a graph index over so many vectors."""
    tier = lambda t: F.struct(*[F.lit(x).alias(n) for x, n in zip(t[1:], ("m", "ef_construction", "ef_search"))])
    out = tier(TIERS[-1])
    for t in reversed(TIERS[:-1]):
        out = F.when(rows < t[0], tier(t)).otherwise(out)
    return out


def reindexed(chunks_: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``chunks_`` with all chunks of the documents in ``new`` replaced by those there."""
    return chunks_.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def cached(cache: DataFrame, wanted: DataFrame, dims: Column) -> DataFrame:
    """``content_hash, model, hit``: of ``wanted``, whether the latest entry is there with as many dimensions as asked for."""
    latest = cache.groupBy("content_hash", "model").agg(F.max(F.struct("ts", "dim"))["dim"].alias("dim"))
    return wanted.join(latest, ["content_hash", "model"], "left").select("content_hash", "model", F.coalesce(F.col("dim") == dims, F.lit(False)).alias("hit"))


def snippets(docs: DataFrame, key: str, text: str, query: list[str], limit: int | None = None, width: int = 200) -> DataFrame:
    """``id, score, snippet`` of the best documents; ``limit`` is kept from 1 to 20, 8 if not given."""
    n = 8 if limit is None else min(max(limit, 1), 20)
    best = bm25(docs, key, text, query).orderBy(F.desc("score"), "id").limit(n)
    return best.join(docs.select(F.col(key).alias("id"), F.left(F.col(text), F.lit(width)).alias("snippet")), "id")


# A citation marker, and the letters of its source.
MARKER = r"\[citation:([^\]]*)\]"
SOURCES = {"V": "vector", "K": "keyword", "R": "fusion"}
_MARKER = re.compile(MARKER)


def marked_citations(text: str) -> tuple[str, list[tuple]]:
    """The text with its markers as numbers, and (number, doc, chunk, start, end, source, score) of each marker in order.

    A marker has four fields, document, chunk, start and end, or six, with source and
    score behind them; others stay as they are. Numbers count the different pairs of
    document and chunk by first appearance. Four fields mean source vector and score 0.
    """
    numbers: dict[tuple[str, str], int] = {}
    found: list[tuple] = []

    def replaced(m: re.Match) -> str:
        f = m[1].split(":")
        try:
            if len(f) not in (4, 6):
                raise ValueError
            start, end = int(f[2]), int(f[3])
            source, score = (SOURCES[f[4][:1]], float(f[5])) if len(f) == 6 else (SOURCES["V"], 0.0)
            if start < 0 or end < 0:
                raise ValueError
        except (ValueError, KeyError):
            return m[0]
        n = numbers.setdefault((f[0], f[1]), len(numbers) + 1)
        found.append((n, f[0], f[1], start, end, source, score))
        return f"[{n}]"

    return _MARKER.sub(replaced, text), found


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, number, doc_id, chunk_id, span_start, span_end, source, score, rewritten``: a row for each marker of a text, which comes rewritten with its first one."""
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
    names = ("place", "number", "doc_id", "chunk_id", "span_start", "span_end", "source", "score", "rewritten")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                new, found = marked_citations(t)
                for place, c in enumerate(found):
                    at.append(i)
                    rows.append((place, *c, new if not place else None))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, *names])

    kind = df.schema[key].dataType.simpleString()
    own = df.select(key, text).filter(F.contains(text, F.lit("[citation:")))
    return own.mapInArrow(run, f"`{key}` {kind}, place int, number int, doc_id string, chunk_id string, span_start long, span_end long, source string, score double, rewritten string")


def index_benchmark(search: Callable[[DataFrame], DataFrame], exact: Callable[[DataFrame], DataFrame], queries: DataFrame) -> dict[str, float]:
    """Mean seconds a query of a search, and the part of the exact result (``query, id``) that it finds."""
    n = queries.count()
    began = time.perf_counter()
    found = stage(search(queries).select("query", "id"))
    seconds = time.perf_counter() - began
    truth = stage(exact(queries).select("query", "id"))
    hits, total = truth.join(found, ["query", "id"], "left_semi").count(), truth.count()
    return {"queries": n, "seconds_a_query": seconds / n if n else 0.0, "recall": hits / total if total else 0.0}
