"""References to records that don't exist, with heavy and light keys on separate ways.

References are first counted per key and period. Keys that hold more than a thousandth
of all references are heavy: there can be at most a thousand of them for each kind, so
their targets' state is small enough to broadcast, and the references to them never
move. The remaining keys are shuffled and anti-joined; none of them can overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.tables import stage

#: A key is heavy from this share of all references on; so there are at most 1 / share.
HEAVY_SHARE = 0.001


def references(df: DataFrame, table_name: str, row_id: str, fields: dict[str, str], ref_time: Column | None, period: Column) -> DataFrame:
    """One row per reference that is neither null nor empty.

    ``fields`` maps a field to the kind of record that it refers to. ``ref_time`` is the
    reference's own time, or None where lateness isn't asked for. The table is scanned
    once for all its fields. Empty tables give no rows; null row ids are kept.
    """
    one = [F.struct(F.lit(f).alias("field_name"), F.lit(kind).alias("kind"), F.col(f).cast("string").alias("key")) for f, kind in fields.items()]
    return (
        df.select(
            F.lit(table_name).alias("table_name"),
            F.col(row_id).cast("string").alias("row_id"),
            (F.lit(None).cast("timestamp") if ref_time is None else ref_time).alias("ref_time"),
            period.cast("string").alias("period"),
            F.explode(F.array(*one)).alias("r"),
        )
        .select("table_name", "row_id", "ref_time", "period", "r.*")
        .filter("key is not null and key <> ''")
    )


def target_state(df: DataFrame, kind: str, key: str, deleted: Column, created: Column | None, version: Column) -> DataFrame:
    """One row per key: whether its latest row is deleted, and when it was created.

    The latest row is the one with the greatest ``version``; of rows with equal
    versions a deleted one holds. Null keys are left out.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
        .agg(
            F.max(F.struct(version.alias("v"), F.coalesce(deleted, F.lit(False)).alias("d")))["d"].alias("deleted"),
            F.max(F.lit(None).cast("timestamp") if created is None else created).alias("created"),
        )
    )


def _reason() -> Column:
    return (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("created") > F.col("ref_time"), "late")
    )


def orphan_references(refs: DataFrame, states: DataFrame) -> DataFrame:
    """The references whose target is missing, deleted or late, one row each per copy of the row.

    ``refs`` as of :func:`references`, ``states`` as of :func:`target_state` (unions of
    both are fine). Adds ``reason``. Null times are never late. Repeated reference rows
    give repeated results; callers take them distinct.
    """
    keys = refs.groupBy("kind", "key", "period").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = keys.agg(F.sum("n").alias("total"))
    heavy = keys.crossJoin(F.broadcast(total)).filter(F.col("n") > F.col("total") * HEAVY_SHARE).select("kind", "key")
    heavy = stage(heavy)  # at most 1 / HEAVY_SHARE rows, read three times
    heavy_state = heavy.join(F.broadcast(states.join(F.broadcast(heavy), ["kind", "key"])), ["kind", "key"], "left")
    on_heavy = refs.join(F.broadcast(heavy_state), ["kind", "key"])
    light = refs.join(F.broadcast(heavy), ["kind", "key"], "left_anti")
    on_light = light.join(states, ["kind", "key"], "left")
    found = on_heavy.unionByName(on_light)
    return found.withColumn("reason", _reason()).filter("reason is not null").select("table_name", "row_id", "field_name", "key", "period", "reason")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and period; repeated rows count once."""
    return orphans.distinct().groupBy("table_name", "field_name", "reason", "period").agg(F.count(F.lit(1)).alias("orphans"))
