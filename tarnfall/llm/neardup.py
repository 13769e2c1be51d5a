"""Near-duplicate texts by a MinHash LSH forest with exact verification.

Texts are reduced to classes of equal normalised text first, so exact copies never meet
in the search. Every class gets a signature, of which each tree reads its own part as a
path. The paths of a tree form a prefix trie: a shuffle brings the paths together that
share the shortest prefix ever used, sorted, so that each node of the trie is a run of
rows and the depth to which two paths agree is read off them. Pairs that agree to the
full depth in some tree are verified first, then those that agree to one level less, and
so on: the matched prefix is shortened until the pairs found so far, weighted by the
probability with which a pair of their similarity is found at that depth, show that the
target recall is reached. The shortest prefix is the one at which even a pair at the
similarity limit is found with ``FLOOR_RECALL``; its pairs, by far the most, are read off
the tries only if the longer ones don't suffice.

Candidates are verified on the texts' whole shingle sets. Before, only pairs go that
can't reach the limit: each text has the numbers of its shingles in ``BINS`` bins, and two
texts share no more than the sum of the lesser numbers. A node of more than ``RUN`` paths
is dealt over tasks as blocks, every two of which meet in one.

Signatures come from one hash per shingle: the hash names a bin and a value, and each
bin keeps its least value. A text with too few different shingles to reach all bins throws them
again, with other hashes, into a later round; earlier rounds win, so two texts agree in
a bin with exactly the probability of their similarity, whatever their lengths.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.llm.codes import SEPARATOR, Rolling, joined, letters, mix
from tarnfall.operators.components import connected_components
from tarnfall.sources.tables import stage

TREES = 26
#: The part of all pairs that is to be found, and the probability with which one at the limit is, at least.
TARGET_RECALL, FLOOR_RECALL = 0.995, 0.99
#: Levels of a path below the shortest prefix.
LEVELS = 3
#: Paths of one node that a task pairs by itself.
RUN = 1000
#: Bins of the numbers of shingles, four bits each.
BINS = 256
#: Classes of sizes grow by this factor; they take eight bits.
_GROWTH = 1.08


def shortest_prefix(similarity: float, trees: int = TREES, recall: float = FLOOR_RECALL) -> int:
    """The longest prefix with which a pair of this similarity meets in some tree with the given probability.

    At 1 the probability may stay below it, which more trees mend.
    """
    depth = 1
    while 1 - (1 - similarity ** (depth + 1)) ** trees >= recall and depth < 64:
        depth += 1
    return depth


def size_classes_apart(similarity: float) -> int:
    """Most size classes between two sets of this similarity, whatever the rounding."""
    return math.ceil(math.log(1 / similarity) / math.log(_GROWTH)) + 1


def normalized(texts: list[str]) -> list[str]:
    """Lower case, runs of other than letters and digits as one space, trimmed."""
    codes, starts = joined([t.lower() for t in texts])
    word = letters()[codes]
    first_gap = ~word
    first_gap[1:] &= word[:-1]  # one space for each run
    codes = codes.copy()
    codes[~word] = 32
    keep = word | first_gap
    moved = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(keep, out=moved[1:])
    data, cuts = codes[keep], moved[starts].tolist()
    ends = data == SEPARATOR
    data[ends] = 10
    whole = data.astype("<u4").tobytes().decode("utf-32-le")
    return [whole[a : b - 1].strip(" ") for a, b in zip(cuts, cuts[1:])]


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-character windows of normalised texts, and the text of each."""
    codes, starts = joined(texts)
    hashes = Rolling(codes).windows(width)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(hashes)]
    inside = np.arange(len(hashes)) + width < starts[1:][owner]
    return mix(hashes[inside]), owner[inside]


def distinct_shingles(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a text once, in order."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def signatures(hashes: np.ndarray, owner: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """One row of ``bins`` values per text, of its distinct shingles; see the module's text."""
    out = np.full(texts * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    counts = np.bincount(owner, minlength=texts)
    draws = bins * math.log(bins * 20)  # so many fill all bins but for one text in twenty
    rounds = np.where(counts > 0, np.ceil(draws / np.maximum(counts, 1)), 0).astype(np.int64)
    active, k = np.ones(len(hashes), dtype=bool), 0
    while True:
        active = np.flatnonzero(rounds[owner] > k) if k == 0 else active[rounds[owner[active]] > k]
        if not len(active):
            break
        h = hashes[active] if k == 0 else mix(hashes[active] + np.uint64(0x9E3779B97F4A7C15 * k % 2**64))
        bin_ = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (np.uint64(k) << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(out, owner[active] * bins + bin_.astype(np.int64), value)
        k += 1
    return out.reshape(texts, bins)


def _class(text: str) -> tuple[int, int]:
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_CODED = "id string, c1 long, c2 long, size int, bins binary, heads array<long>, tails array<long>"


def coded(df: DataFrame, id_column: str, text_columns: list[str], width: int, trees: int, prefix: int) -> DataFrame:
    """``id``, class (128 bits), binned numbers of shingles and a path for each tree, for each row that has shingles.

    A head stands for a tree and the first ``prefix`` values of the path in it; a tail
    holds sixteen bits of each of the other ``LEVELS`` values, the first one highest, and
    below them the text's size class. The text is the first of ``text_columns`` that is
    neither null nor blank. Texts of fewer than ``width`` normalised characters have no
    shingles and give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(trees, dtype=np.uint64) + np.uint64(77))
        depth = prefix + LEVELS
        for batch in batches:
            for b in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                columns = [b.column(k + 1).to_pylist() for k in range(len(text_columns))]
                texts = normalized([next((t for t in row if t and t.strip()), "") for row in zip(*columns)])
                some = [k for k, t in enumerate(texts) if len(t) >= width]
                texts = [texts[k] for k in some]
                hashes, owner = distinct_shingles(*shingle_hashes(texts, width))
                sig = signatures(hashes, owner, len(texts), trees * depth)
                head = np.tile(seeds, (len(texts), 1))
                for level in range(prefix):
                    head = mix(head ^ sig[:, level::depth])
                sizes = np.bincount(owner, minlength=len(texts))
                tail = np.zeros((len(texts), trees), dtype=np.uint64)
                for level in range(prefix, depth):
                    tail = (tail << np.uint64(16)) | (mix(sig[:, level::depth]) >> np.uint64(48))
                bins = np.bincount(owner * BINS + (hashes >> np.uint64(56)).astype(np.int64), minlength=len(texts) * BINS)
                bins = np.minimum(bins, 15).astype(np.uint8)
                bins = (bins[::2] << 4) | bins[1::2]
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 2), len(texts), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
                size = np.minimum(np.log(np.maximum(sizes, 1)) / math.log(_GROWTH), 255).astype(np.uint64)
                tail = (tail << np.uint64(8)) | size[:, None]
                c = [_class(t) for t in texts]
                cuts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * trees)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.view(np.int64).ravel())) for x in (head, tail)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(some, pa.int64())), pa.array([x for x, _ in c], pa.int64()), pa.array([x for _, x in c], pa.int64()), pa.array(sizes, pa.int32()), packed, *lists],
                    names=["id", "c1", "c2", "size", "bins", "heads", "tails"],
                )

    return df.select(F.col(id_column).cast("string"), *text_columns).filter(F.col(id_column).isNotNull()).mapInArrow(run, _CODED)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the levels in two tails agree, from the first one on."""
    apart = (a ^ b).view(np.uint64)
    return sum((apart >> np.uint64(8 + 16 * (LEVELS - 1 - k)) == 0).astype(np.int32) for k in range(LEVELS))


_WALKED = "node long, a long, b long, tail long, n int"


def _batch(node, a, b, tail, n) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) if x is not None else pa.nulls(len(a), pa.int64()) for x in (node, a, b, tail)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32())], names=["node", "a", "b", "tail", "n"])


def _met(a: np.ndarray, b: np.ndarray, classes: np.ndarray, tails: np.ndarray, apart: int, level: int) -> Iterator[pa.RecordBatch]:
    """Pairs of places as pairs of classes, the smaller one first, and their agreement; at level 0 only those without any."""
    near = (np.abs((tails[a] & 255) - (tails[b] & 255)) <= apart) & (classes[a] != classes[b])
    if not level:
        near &= _agreement(tails[a], tails[b]) == 0
    if near.any():
        a, b = a[near], b[near]
        x, y = classes[a], classes[b]
        yield _batch(None, np.minimum(x, y), np.maximum(x, y), None, _agreement(tails[a], tails[b]))


def _walk(apart: int, level: int):
    """Rows (head, tail, class), in order: the pairs of each node ``level`` levels below a head; the paths of large nodes as they are, numbered by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, large, seen = [np.zeros(0, dtype=np.int64)] * 3, None, 0
        for b in chain(batches, [None]):
            heads, tails, classes = kept if b is None else (np.concatenate([k, b.column(i).to_numpy()]) for i, k in enumerate(kept))
            if not len(heads):
                continue
            nodes = mix(heads.view(np.uint64) ^ mix(tails.view(np.uint64) >> np.uint64(8 + 16 * (LEVELS - level)))).view(np.int64) if level else heads
            starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            sizes = np.diff(np.append(starts, len(nodes)))
            last = len(starts) - (b is not None)  # the next batch may go on with this one
            big = sizes > RUN
            if large is not None:
                big |= nodes[starts] == large
            for k in np.flatnonzero(big).tolist():
                at = slice(starts[k], starts[k] + sizes[k])
                if large != nodes[at.start]:
                    large, seen = nodes[at.start], 0
                yield _batch(nodes[at], classes[at], None, tails[at], (seen + np.arange(sizes[k])) // RUN)
                seen += sizes[k]
            ready = ~big & (sizes > 1)
            ready[last:] = False
            for m in np.unique(sizes[ready]).tolist():
                i, j = np.triu_indices(m, 1)
                first, step = starts[ready & (sizes == m)][:, None], max(1, 1_000_000 // len(i))
                for at in range(0, len(first), step):
                    yield from _met((first[at : at + step] + i).ravel(), (first[at : at + step] + j).ravel(), classes, tails, apart, level)
            rest = starts[last] if last < len(starts) and not big[last] else len(heads)
            kept = [heads[rest:], tails[rest:], classes[rest:]]

    return run


def _blocks(apart: int, level: int):
    """Two blocks of a large node, or one twice: their pairs."""

    def run(rows: pa.Table) -> pa.Table:
        n, tails, classes = (rows.column(c).to_numpy() for c in ("n", "tail", "a"))
        lo, hi = np.flatnonzero(n == n.min()), np.flatnonzero(n == n.max())
        i, j = np.triu_indices(len(n), 1) if n.min() == n.max() else (np.repeat(lo, len(hi)), np.tile(hi, len(lo)))
        found = list(_met(i, j, classes, tails, apart, level))
        return pa.Table.from_batches(found or [_batch(*[np.zeros(0, dtype=np.int64)] * 5)])

    return run


def trie_pairs(paths: DataFrame, apart: int, level: int) -> DataFrame:
    """``c1, d1, n``: classes whose paths share a head, and in how many further levels they agree at most.

    From level 1 on, pairs that agree in fewer levels are left out, at level 0 all others.
    ``paths`` has ``head, tail, c1``.
    """
    walked = stage(paths.select("head", "tail", "c1").repartition("head").sortWithinPartitions("head", "tail").mapInArrow(_walk(apart, level), _WALKED))
    met = walked.filter("b is not null")
    large = walked.filter("b is null")
    if not large.isEmpty():
        blocks = large.groupBy("node").agg((F.max("n") + 1).alias("blocks"))
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("n", k).alias("i"), F.greatest("n", k).alias("j"))))
        dealt = large.join(blocks, "node").select("node", "a", "tail", "n", other.alias("of")).select("node", "a", "tail", "n", "of.i", "of.j")
        met = met.unionByName(dealt.groupBy("node", "i", "j").applyInArrow(_blocks(apart, level), _WALKED))
    return met.groupBy(F.col("a").alias("c1"), F.col("b").alias("d1")).agg(F.max("n").alias("n"))


def _texts(columns: int, width: int):
    """Class and normalised text of rows (id, text columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = normalized([next((t for t in row if t and t.strip()), "") for row in zip(*(b.column(k + 1).to_pylist() for k in range(columns)))])
            texts = [t for t in texts if len(t) >= width]
            c = [_class(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in c], pa.int64()), pa.array([x for _, x in c], pa.int64()), pa.array(texts, pa.string())], names=["c1", "c2", "text"])

    return run


def _verify(similarity: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
            n = b.num_rows
            hashes, owner = distinct_shingles(*shingle_hashes(b.column(4).to_pylist() + b.column(5).to_pylist(), width))
            sizes = np.bincount(owner, minlength=2 * n)
            pair = owner % n
            order = np.lexsort((hashes, pair))
            hashes, pair = hashes[order], pair[order]
            twice = (hashes[1:] == hashes[:-1]) & (pair[1:] == pair[:-1])
            both = np.bincount(pair[1:][twice], minlength=n)
            near = both / np.maximum(sizes[:n] + sizes[n:] - both, 1)
            keep = pa.array(near >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(keep) for k in range(4)), pa.array(near).filter(keep)], names=["c1", "c2", "d1", "d2", "similarity"])

    return run


def _possible(similarity: float):
    """Rows (a, b, n, size and bins of both): those that the numbers in the bins don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(k, 4096) for batch in batches for k in range(0, batch.num_rows, 4096)):
            sizes = [b.column(k).to_numpy().astype(np.int64) for k in (3, 5)]
            bins, beyond = [], []
            for k, size in zip((4, 6), sizes):
                packed = np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(b.num_rows, BINS // 2)
                x = np.concatenate([packed >> 4, packed & 15], axis=1)
                bins.append(x)
                beyond.append(size - np.where(x < 15, x, 0).sum(1, dtype=np.int64))  # shingles in full bins
            full = (bins[0] == 15) & (bins[1] == 15)
            shared = np.where(full, 0, np.minimum(*bins)).sum(1, dtype=np.int64) + np.where(full.any(1), np.minimum(*beyond), 0)
            shared = np.minimum(shared, np.minimum(*sizes))
            keep = pa.array(shared >= similarity * (sizes[0] + sizes[1] - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in range(3)], names=["c1", "d1", "n"])

    return run


def enough(found: DataFrame, depth: int, trees: int, similarity: float, recall: float) -> bool:
    """Whether the pairs ``found`` at prefixes of ``depth`` or more are the target part of all there are.

    Each stands for 1 / P pairs, P being the probability that a pair of its similarity is
    found. What is missing by that sum counts with three standard deviations, and with
    three pairs at the limit that nothing was seen of, so few pairs never end the search.
    """
    p = lambda s: 1 - (1 - s**depth) ** trees
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(float(depth))), F.lit(float(trees)))
    n, lost, spread = found.agg(F.count(F.lit(1)), F.coalesce(F.sum((1 - chance) / chance), F.lit(0.0)), F.coalesce(F.sum((1 - chance) / (chance * chance)), F.lit(0.0))).first()
    missing = lost + 3 * math.sqrt(spread) + 3 * (1 - p(similarity)) / p(similarity)
    return n > 0 and missing <= (1 - recall) * n


class NearDuplicates:
    """The search's results: members of the classes, and the verified pairs of classes.

    Deterministic: hashes are fixed. Null ids and texts without shingles are left out;
    repeated rows count once; of one id with several texts each text counts as a member.
    """

    def __init__(self, df: DataFrame, id_column: str, text_columns: list[str], similarity: float = 0.8, width: int = 5, trees: int = TREES, recall: float = TARGET_RECALL):
        prefix = shortest_prefix(similarity, trees)
        code = stage(coded(df, id_column, text_columns, width, trees, prefix))
        self.members = code.select("id", "c1", "c2").distinct()
        classes = code.dropDuplicates(["c1", "c2"])
        paths = classes.select("c1", F.explode(F.arrays_zip("heads", "tails")).alias("p")).select(F.col("p.heads").alias("head"), F.col("p.tails").alias("tail"), "c1")
        rows = df.select(F.col(id_column).cast("string").alias("id"), *text_columns)
        found = None
        for lowest in (1, 0):
            # half of the class names a candidate; the texts, which are joined to it, have the whole
            met = trie_pairs(paths, size_classes_apart(similarity), lowest)
            candidates = self._possible(met if found is None else met.join(earlier, ["c1", "d1"], "left_anti"), classes, similarity)
            earlier = candidates.select("c1", "d1")
            texts = self._texts(rows, candidates, text_columns, width)
            a = texts.withColumnRenamed("text", "text_a")
            b = texts.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("text").alias("text_b"))
            for level in range(LEVELS if lowest else 0, lowest - 1, -1):
                paired = candidates.filter(F.col("n") == level).join(a, "c1").join(b, "d1").select("c1", "c2", "d1", "d2", "text_a", "text_b")
                more = stage(paired.mapInArrow(_verify(similarity, width), "c1 long, c2 long, d1 long, d2 long, similarity double"))
                found = more if found is None else found.unionByName(more)
                self.depth = prefix + level
                if enough(found, self.depth, trees, similarity, recall):
                    break
            else:
                continue
            break
        self.class_pairs = found.drop("similarity")

    @staticmethod
    def _possible(candidates: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
        a = classes.select("c1", "size", "bins")
        b = classes.select(F.col("c1").alias("d1"), F.col("size").alias("size_b"), F.col("bins").alias("bins_b"))
        both = candidates.join(a, "c1").join(b, "d1").select("c1", "d1", "n", "size", "bins", "size_b", "bins_b")
        return stage(both.mapInArrow(_possible(similarity), "c1 long, d1 long, n int"))

    def _texts(self, rows: DataFrame, candidates: DataFrame, text_columns: list[str], width: int) -> DataFrame:
        ends = candidates.select("c1").union(candidates.select("d1")).distinct()
        chosen = self.members.join(ends, "c1", "left_semi").groupBy("c1", "c2").agg(F.min("id").alias("id")).select("id").distinct()
        own = rows.join(chosen, "id", "left_semi").mapInArrow(_texts(len(text_columns), width), "c1 long, c2 long, text string")
        return stage(own.join(ends, "c1", "left_semi").dropDuplicates(["c1", "c2"]))

    def pairs(self) -> DataFrame:
        """``id_a < id_b`` of all near-duplicate rows, exact copies included."""
        m = self.members
        n = m.select(F.col("id").alias("other"), F.col("c1").alias("d1"), F.col("c2").alias("d2"))
        several = m.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("c1", "c2")
        copies = several.select("c1", "c2", F.col("c1").alias("d1"), F.col("c2").alias("d2"))
        both = self.class_pairs.unionByName(copies)
        return both.join(m, ["c1", "c2"]).join(n, ["d1", "d2"]).filter("id <> other").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """``id, class_id, group_id, links``: one row per text of an id.

        Equal texts share the class; classes that are linked, directly or over others,
        share the group; ``links`` counts the other classes that the class is linked to.
        """
        name = lambda x, y: F.concat_ws("_", F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
        edges = self.class_pairs.select(name("c1", "c2").alias("a"), name("d1", "d2").alias("b"))
        groups = connected_components(edges).withColumnRenamed("node", "class_id")
        links = edges.select("a").union(edges.select("b")).toDF("class_id").groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
        return (
            self.members.select("id", name("c1", "c2").alias("class_id"))
            .join(groups.join(links, "class_id"), "class_id", "left")
            .select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
        )
