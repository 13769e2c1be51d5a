"""Usage statistics, votes and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trailing periods in seconds; None is all time.
PERIODS = {"minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000, "all": None}


def trailing_stats(df: DataFrame, time: str, anchor: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums and counts over every trailing period, in one pass; ``anchor`` has one row, ``now``.

    The lower bound is inclusive and there is no upper one. A row counts in every period
    that it reaches: it is expanded into at most six, before partial aggregation.
    """
    rows = df.crossJoin(F.broadcast(anchor))  # one row
    periods = F.array(*[F.when(F.lit(s is None) | (F.unix_micros(F.col(time).cast("timestamp")) >= F.unix_micros(F.col("now").cast("timestamp")) - (s or 0) * 1_000_000), F.lit(name)) for name, s in PERIODS.items()])
    each = rows.withColumn("period", F.explode(F.filter(periods, lambda p: p.isNotNull())))
    return each.groupBy("period", *keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()], F.count(F.lit(1)).alias("records"))


def filled_buckets(df: DataFrame, time: str, anchor: DataFrame, unit: str, n: int, value: Column) -> DataFrame:
    """``bucket, value, records`` of the last ``n`` units up to the anchor's, zero-filled."""
    step = {"hour": "make_interval(0,0,0,0,i,0,0)", "day": "make_interval(0,0,0,i,0,0,0)", "month": "make_interval(0,i,0,0,0,0,0)"}[unit]
    spine = anchor.select(F.date_trunc(unit, "now").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(F.expr(f"end - {step}").alias("bucket"))
    got = df.groupBy(F.date_trunc(unit, time).alias("bucket")).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("c"))
    return got.join(F.broadcast(spine), "bucket", "right").select("bucket", F.coalesce("v", F.lit(0)).alias("value"), F.coalesce("c", F.lit(0)).alias("records"))


def best_by(df: DataFrame, key: str, value: str, score: str, order: str) -> DataFrame:
    """Per key the value with the highest score; the first in ``order`` wins ties."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(F.col(score), -F.col(order))).alias(value), F.max(score).alias(score))


def mean_vote(ballots: DataFrame, candidate: str, score: str) -> DataFrame:
    """``candidate, mean, votes, winner``: scores that aren't finite don't count; ties to the smaller candidate."""
    finite = F.when(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), F.col(score))
    means = ballots.groupBy(candidate).agg(F.avg(finite).alias("mean"), F.count(finite).alias("votes"))
    best = means.agg(F.max("mean").alias("_best"))
    at_best = means.crossJoin(F.broadcast(best)).filter(F.col("mean").eqNullSafe(F.col("_best")))  # one row
    first = at_best.agg(F.min(candidate).alias("_first"))
    return means.crossJoin(F.broadcast(first)).withColumn("winner", F.col(candidate) == F.col("_first")).drop("_first")  # one row


def borda_vote(ballots: DataFrame, ballot: str, candidate: str, score: str) -> DataFrame:
    """``candidate, points``: on each ballot, a candidate gets a point for each one ranked below; scores that aren't finite don't count."""
    w = Window.partitionBy(ballot)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    ranked = ballots.filter(finite).withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), candidate))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.groupBy(candidate).agg(F.sum(F.col("_n") - F.col("_r")).alias("points"))


def quorum(verdicts: DataFrame, key: str, passed: Column, at_least: int = 1) -> DataFrame:
    """``majority, unanimous, enough, passes, verdicts``; a missing verdict fails all three, ``enough`` asks for ``at_least`` passes."""
    g = verdicts.groupBy(key).agg(F.sum(F.when(passed, 1).otherwise(0)).alias("passes"), F.count(F.lit(1)).alias("verdicts"), F.count(F.when(passed.isNull(), 1)).alias("_m"))
    whole = F.col("_m") == 0
    return g.select(key, "passes", "verdicts", (whole & (F.col("passes") >= F.floor(F.col("verdicts") / 2) + 1)).alias("majority"), (whole & (F.col("passes") == F.col("verdicts"))).alias("unanimous"), (whole & (F.col("passes") >= at_least)).alias("enough"))


def nearest_rank(df: DataFrame, key: str, value: str, part: float, name: str) -> DataFrame:
    """``key, name``: of each key's values in order, the one at floor(part * n), at most the last; null values don't count.

    Equal values are counted first; what is put in order is a row per different value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(key).agg(F.sum("_c").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.least(F.floor(F.col("_n") * part), F.col("_n") - 1)
    return upto.join(total, key).filter(F.col("_upto") > at).groupBy(key).agg(F.min(value).alias(name))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sums ``records, total, last_ts`` put together."""
    return parts.groupBy(*keys).agg(F.sum("records").alias("records"), F.sum("total").alias("total"), F.max("last_ts").alias("last_ts"))


def level_for(points: Column) -> Column:
    """1 and one more at 100, 400, 900 ... points."""
    return F.floor(F.sqrt(points / 100)) + 1


def touched(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row per key: when it was made, last touched, and how often it came."""
    return rows.groupBy(*keys).agg(F.min(time).alias("created"), F.max(time).alias("touched"), F.count(F.lit(1)).alias("times"))


def applied(memories: DataFrame, decay: float, least: float, reinforced: DataFrame, gain: float, superseded: DataFrame, new: DataFrame) -> DataFrame:
    """``k, strength`` after decay, reinforcement, supersession and insertion, in this order.

    What decays below ``least`` goes; ``reinforced`` and ``superseded`` name keys; a new
    row whose key is there already is left out. The factors are ours.
    """
    weak = memories.withColumn("strength", F.col("strength") * decay).filter(F.col("strength") >= least)
    strong = weak.join(reinforced.select("k").distinct().withColumn("_r", F.lit(gain)), "k", "left").withColumn("strength", F.col("strength") + F.coalesce("_r", F.lit(0.0))).drop("_r")
    left = strong.join(superseded.select("k").distinct(), "k", "left_anti").select("k", "strength")
    return left.unionByName(new.join(left.select("k"), "k", "left_anti").select("k", "strength"))
