"""Ranking, retention and sequence operators over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.functions import text as T


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def drop_oldest(df: DataFrame, keys: list[str], order: list[Column], part: int = 5) -> DataFrame:
    """Without the oldest 1/``part`` of each key's rows, at least one; a single row stays."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    cut = F.when(n > 1, F.greatest(F.lit(1), F.floor(n / part))).otherwise(0)
    return df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_cut", cut).filter("_n > _cut").drop("_n", "_cut")


def collapse_repeats(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_b", before).filter(~F.col("_b").eqNullSafe(F.col(value)) | F.col("_b").isNull()).drop("_b")


def sequence_patterns(df: DataFrame, session: str, order: list[Column], value: str, shortest: int = 2, longest: int = 5) -> DataFrame:
    """``pattern, length, total, sessions`` of all runs of values, repeats collapsed first."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = collapse_repeats(df, [session], order, value)
    rows = rows.select(session, value, *[F.lead(value, k).over(w).alias(f"_{k}") for k in range(1, longest)])
    runs = [F.when(F.col(f"_{n - 1}").isNotNull(), F.array(value, *[F.col(f"_{k}") for k in range(1, n)])) for n in range(shortest, longest + 1)]
    each = rows.select(F.col(session).alias("s"), F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("p"))
    counted = each.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sessions"))
    return counted.select(F.array_join("p", " > ").alias("pattern"), F.size("p").alias("length"), "total", "sessions")


def maximal_patterns(patterns: DataFrame, least_sessions: int, least_total: int = 1) -> DataFrame:
    """Patterns seen often enough, in enough sessions, that no longer one contains with as many sessions.

    Containment is an equi-join: each long pattern is taken apart into its runs.
    """
    enough = patterns.filter((F.col("sessions") >= least_sessions) & (F.col("total") >= least_total))
    p = F.split("pattern", " > ")
    inner = enough.select("sessions", p.alias("p"), F.size(p).alias("n")).filter("n > 2")
    cuts = inner.select("sessions", "p", "n", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m")).select("sessions", "p", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("at"))
    inside = cuts.select(F.array_join(F.slice("p", F.col("at"), F.col("m")), " > ").alias("pattern"), F.col("sessions").alias("more")).groupBy("pattern").agg(F.max("more").alias("more"))
    return enough.join(inside, "pattern", "left").filter("more is null or more < sessions").drop("more")


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row; null before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gaps(df: DataFrame, keys: list[str], time: str, order: list[Column], seconds: int) -> DataFrame:
    """``session``: counts up wherever more than ``seconds`` passed since the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(F.col(time).cast("timestamp")).over(w)) > seconds * 1_000_000).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_lengths(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """``run``: how many rows up to this one, without a break, have this row's value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = df.withColumn("_c", change).withColumn("_island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("run", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(*order))).drop("_c", "_island")


def repeated_failures(df: DataFrame, keys: list[str], order: list[Column], failed: Column, n: int = 3) -> DataFrame:
    """Rows at which an action is due: every ``n``-th failure in a row, counting anew after each."""
    runs = run_lengths(df.withColumn("_f", failed), keys, order, "_f")
    return runs.filter(F.col("_f") & (F.col("run") % n == 0)).drop("_f", "run")


def newest_days(df: DataFrame, millis: Column, now_millis: Column, days: int) -> DataFrame:
    """Rows of the newest ``days`` UTC days, today included; 0 keeps all."""
    return df if not days else df.filter(F.floor(millis / 86_400_000) > F.floor(now_millis / 86_400_000) - days)


def turn_signatures(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``signature``: the values of each group, sorted, so order within doesn't matter."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias("signature"))


def long_sessions(df: DataFrame, session: str, order: list[Column], value: str, time: str, least: int, first: int) -> DataFrame:
    """``session, steps, first_steps, start_ts, end_ts`` of sessions with enough steps, repeats collapsed; the ``first`` ones are listed."""
    rows = collapse_repeats(df, [session], order, value)
    w = Window.partitionBy(session)
    n = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)))
    steps = rows.groupBy(session).agg(F.count(F.lit(1)).alias("steps")).filter(F.col("steps") >= least)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", value))), lambda x: x[value]), " > ")  # ``first`` rows at most
    taken = n.filter(F.col("_k") <= first).groupBy(session).agg(names.alias("first_steps"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts"))
    return steps.join(taken, session).select(session, "steps", "first_steps", "start_ts", "end_ts")


def freed_tokens(df: DataFrame, key: str, order: list[Column], content: str, keep: int) -> DataFrame:
    """``key, cleared, freed``: rows beyond the first ``keep``, at least one, in order, and a fourth of their bytes, each rounded down."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    gone = F.col("_k") > max(keep, 1)
    return ranked.groupBy(key).agg(F.count(F.when(gone, 1)).alias("cleared"), F.coalesce(F.sum(F.when(gone, F.floor(F.octet_length(content) / 4))), F.lit(0)).alias("freed"))


def idle_decision(idle_millis: Column, asked: Column, chars: Column, minutes: int, least_chars: int) -> Column:
    """wait before so many minutes of silence, then archive if something was asked and enough was written, else skip."""
    return F.when(idle_millis < max(minutes, 1) * 60_000, "wait").when((asked >= 1) & (chars >= least_chars), "archive").otherwise("skip")


def loop_guard(df: DataFrame, keys: list[str], order: list[Column], signature: str, n: int) -> DataFrame:
    """``action``: nudge from the ``n``-th equal signature in a row on, abort from twice as many on, else go on."""
    run = F.col("run")
    return run_lengths(df, keys, order, signature).withColumn("action", F.when(run >= 2 * n, "abort").when(run >= n, "nudge").otherwise("go on"))


def topic_matches(messages: DataFrame, topics: list[str], most: int) -> DataFrame:
    """``id, topic, direct, hits`` of messages ``id, text`` that hold a topic's title or two of its keywords, the first ``most`` topics each.

    ``topics`` is a hot list of a few titles, the first one first; each becomes a condition on the message.
    """
    form = T.search_form(F.col("text"))
    spark = messages.sparkSession
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(topics)], "n int, t string").select("n", T.search_form(F.col("t")).alias("title"), F.transform(T.title_keywords(F.col("t")), T.search_form).alias("words")).collect()
    found = []
    for r in rows:
        title, words = r["title"], [w for w in r["words"] if w]
        if not title:
            continue
        direct = F.contains(form, F.lit(title)) | (F.contains(F.lit(title), form) if len(title) >= 4 else F.lit(False))
        hits = sum((F.contains(form, F.lit(w)).cast("int") for w in words), F.lit(0))
        found.append(F.when(direct | (hits >= 2), F.struct(F.lit(topics[r["n"]]).alias("topic"), direct.alias("direct"), hits.alias("hits"))))
    if not found:
        return messages.filter("false").select("id", F.lit("").alias("topic"), F.lit(True).alias("direct"), F.lit(0).alias("hits"))
    return messages.filter(form != "").select("id", F.explode(F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most)).alias("x")).select("id", "x.topic", "x.direct", "x.hits")
