"""Mixing sources to target weights.

Every record is counted in tokens of a public tokenizer once. Weights run through a tree
of domain, language and source: a source's share is split over its languages as its
tokens are. Where a leaf can't supply its budget, not even repeated as often as allowed,
its siblings take the rest over by their weights, and only what they can't take goes up
to the next level. The tree has one leaf per source and language and is solved on the
driver; records never go there.

A leaf's budget is then filled by epochs: whole passes over its records, and of the last
epoch the prefix, in an order seeded by epoch, whose tokens come nearest to the rest. The
prefix is found by sums per slice of the order first; only the one slice in which the
prefix ends is summed record by record, so no task ever orders a whole source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.sources.tables import stage

SLICE_BITS = 14
#: Most sources with a target; the tree of sources and languages is solved on the driver.
MOST_SOURCES = 100_000
_LONG_TEXT = 200_000

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _sections(text: str, pattern: str) -> Iterator[str]:
    """A very long text in parts, each a row of whole pieces of the tokenizer's own pattern."""
    import regex

    start = end = 0
    for piece in regex.finditer(pattern, text):
        if piece.end() - start > _LONG_TEXT and end > start:
            yield text[start:end]
            start = end
        end = piece.end()
    yield text[start:]


def token_counts(df: DataFrame, id_column: str, text_column: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """``id``, the columns of ``keep`` as text, and ``tokens``; a null text has 0 tokens."""
    path = tokenizer or default_tokenizer()
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        encode, pattern = encoding.encode_ordinary, encoding._pat_str
        for b in batches:
            n = [0 if t is None else len(encode(t)) if len(t) <= _LONG_TEXT else sum(len(encode(s)) for s in _sections(t, pattern)) for t in b.column(len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep) + 1)), pa.array(n, pa.int64())], names=["id", *keep, "tokens"])

    columns = [F.col(id_column).alias("id"), *(F.col(c).cast("string").alias(c) for c in keep), F.col(text_column)]
    return df.select(*columns).mapInArrow(run, f"id {kind}, {', '.join(f'{c} string' for c in keep)}, tokens long")


def _pour(amount: float, nodes: list[dict]) -> float:
    """Give ``amount`` to nodes by weight up to their room; returns what found none."""
    open_ = [n for n in nodes if n["room"] > 1e-9 and n["weight"] > 0]
    while amount > 1e-6 and open_:
        total = sum(n["weight"] for n in open_)
        full = [n for n in open_ if n["room"] <= amount * n["weight"] / total + 1e-12]
        if not full:
            for n in open_:
                give = amount * n["weight"] / total
                n["got"] += give
                n["room"] -= give
            return 0.0
        for n in full:
            amount -= n["room"]
            n["got"] += n["room"]
            n["room"] = 0.0
        open_ = [n for n in open_ if n["room"] > 1e-9]
    return max(0.0, amount)


def budgets(leaves: list[dict], total: float) -> None:
    """Set ``got``, the budget, of leaves with ``path, weight, capacity``; see the module's text.

    ``path`` is a tuple from the top; the last part names the leaf.
    """
    for x in leaves:
        x["room"], x["got"] = float(x["capacity"]), 0.0

    def spread(nodes: list[dict], amount: float) -> float:
        """Each node its part of ``amount``; shortages first among all of ``nodes``."""
        weight = sum(n["weight"] for n in nodes)
        short = 0.0
        if weight <= 0:
            return amount
        for n in nodes:
            short += give(n, amount * n["weight"] / weight)
        while short > 1e-6:
            able = [n for n in nodes if room(n) > 1e-6]
            if not able:
                return short
            weight = sum(n["weight"] for n in able)
            if weight <= 0:
                return short
            before, short = short, sum(give(n, short * n["weight"] / weight) for n in able)
            if before - short < 1e-9:
                return short
        return 0.0

    def room(n: dict) -> float:
        return sum(map(room, n["children"])) if "children" in n else n["room"]

    def give(n: dict, amount: float) -> float:
        if "children" not in n:
            return _pour(amount, [n]) if n["weight"] > 0 else amount
        return n["spread"](n["children"], amount)

    def tree(own: list[dict], level: int) -> list[dict]:
        if all(len(x["path"]) == level + 1 for x in own):
            return own
        groups: dict = {}
        for x in own:
            groups.setdefault(x["path"][level], []).append(x)
        return [{"weight": sum(x["weight"] for x in g), "children": tree(g, level + 1), "spread": spread} for _, g in sorted(groups.items())]

    spread(tree(leaves, 0), float(total))


class Mix:
    """The chosen records and the shares that they make.

    ``documents`` needs the id, text, source and language columns; ``targets`` has
    ``source, target_share, max_repeats``. ``total_tokens`` is the size of the mix; left
    out, it is the largest at which no source that has any tokens falls short, so that
    the shares are met as nearly as they can be. Records without tokens, without a
    source or of sources that aren't targets are never chosen; a null language is a
    language of its own. ``domains`` gives the domain of each source; without it the tree
    has only languages and sources. Ids should be unique; equal ones are drawn alike.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", lang_column: str = "lang", total_tokens: int | None = None, tokenizer: str | None = None, domains: dict[str, str] | None = None, seed: int = 42):
        rows = targets.select("source", "target_share", "max_repeats").distinct().limit(MOST_SOURCES + 1).collect()  # to refuse more, not to use a part
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than MOST_SOURCES = {MOST_SOURCES} sources have a target")
        wanted = {r[0]: (float(r[1]), int(r[2])) for r in rows}
        above = lambda source: () if domains is None else (domains.get(source, ""),)
        rows = documents.select(id_column, text_column, F.col(source_column).alias("source"), F.coalesce(F.col(lang_column), F.lit("")).alias("lang")).filter(F.col("source").isin(*wanted))
        counted = stage(token_counts(rows, id_column, text_column, ["source", "lang"], tokenizer).filter("tokens > 0"))
        self.records = counted
        sums = counted.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()  # a row per source and language
        of_source: dict = {}
        for r in sums:
            of_source[r[0]] = of_source.get(r[0], 0) + r[2]
        leaves = [{"path": (*above(r[0]), r[1], r[0]), "weight": wanted[r[0]][0] * r[2] / of_source[r[0]], "capacity": r[2] * wanted[r[0]][1], "tokens": r[2]} for r in sorted(sums)]
        for s, (share, _) in wanted.items():
            if s not in of_source:  # its share goes to its siblings
                leaves.append({"path": (*above(s), "", s), "weight": share, "capacity": 0, "tokens": 0})
        if total_tokens is None:
            total_tokens = int(min((n * wanted[s][1] / wanted[s][0] for s, n in of_source.items() if wanted[s][0] > 0), default=0))
        self.total_tokens = total_tokens
        budgets(leaves, total_tokens)
        plan = [(x["path"][-1], x["path"][-2], int(x["got"] // x["tokens"]), float(x["got"] % x["tokens"])) for x in leaves if x["tokens"]]
        spark = documents.sparkSession
        leaf = F.broadcast(spark.createDataFrame(plan, "source string, lang string, passes int, rest double"))
        order = F.xxhash64(F.lit(seed), F.col("passes"), F.col("id"))  # the last epoch's number seeds its order
        placed = counted.join(leaf, ["source", "lang"]).withColumn("o", order).withColumn("slice", F.shiftrightunsigned("o", 64 - SLICE_BITS))
        per_slice = placed.groupBy("source", "lang", "slice").agg(F.sum("tokens").alias("n"))
        before = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = per_slice.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most 2**SLICE_BITS rows a leaf
        ends_in = starts.join(leaf, ["source", "lang"]).filter("start <= rest and start + n > rest").select("source", "lang", F.col("slice").alias("last"), "start")
        known = placed.join(F.broadcast(ends_in), ["source", "lang"], "left")  # one row a leaf
        whole = known.filter("last is null or slice <> last").withColumn("more", F.when(F.col("last").isNull(), F.lit(0)).otherwise((F.col("slice") < F.col("last")).cast("int")))
        within = Window.partitionBy("source", "lang").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
        half = F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens") / 2
        partly = known.filter("slice = last").withColumn("more", (half <= F.col("rest")).cast("int"))
        columns = ["id", "source", "lang", "tokens", (F.col("passes") + F.col("more")).alias("repeats")]
        self.chosen = whole.select(*columns).unionByName(partly.select(*columns)).filter("repeats > 0")
        self._targets = spark.createDataFrame([(s, share, n) for s, (share, n) in wanted.items()], "source string, target_share double, max_repeats int")

    def shares(self) -> DataFrame:
        """Per source: target and actual share, tokens available and used, records and their uses."""
        used = self.chosen.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
        there = self.records.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
        every = Window.partitionBy(F.lit(1))  # one row a source
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        both = self._targets.join(there, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", *map(zero, ("available_tokens", "records", "uses", "most_repeats", "tokens")))
        return both.withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)), 6))
