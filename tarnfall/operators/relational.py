"""Filters, keyed writes, paging and other relational building blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.sources.tables import stage


# Phrases of operations that can't be undone.
DESTRUCTIVE = ["rm -rf", "rm -fr", "drop table", "drop database", "truncate", "delete from", "force push", "push --force", "push -f", "reset --hard", "git clean -", "mkfs", "dd if=", "> /dev/"]
# Phrases that decline.
CANCELLING = ["取消", "放弃", "跳过", "稍后", "暂不", "退出", "以后再", "什么都不", "都不选", "不需要", "cancel", "skip", "abort", "quit", "go back", "none of", "do nothing", "nevermind", "never mind"]


def every(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains_any_case(text: str, *columns: str) -> Column:
    """Whether one of the columns contains ``text``, whatever its case; wildcards are plain characters."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])


def number_or_text(query: str, number: str, *columns: str) -> Column:
    """``#123`` asks for that number, anything else for a text in one of the columns."""
    return F.col(number) == int(query[1:]) if query[:1] == "#" and query[1:].isdigit() else contains_any_case(query, *columns)


def has_tag(json_array: str, tag: str) -> Column:
    """Whether a JSON array of strings, held as text, has the tag; bad JSON has none."""
    return F.coalesce(F.array_contains(F.from_json(json_array, "array<string>"), tag), F.lit(False))


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def null_or_not_in(column: str, values: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(values)


def expired(column: str, now: Column) -> Column:
    return F.col(column).isNotNull() & (F.col(column) < now)


def any_phrase(column: str, phrases: list[str]) -> Column:
    """Whether a lower-cased text contains one of the phrases."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(p)) for p in phrases])


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; the tasks cut their own rows first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Ties must be broken by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys. New keys must be unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet are added; running it again changes nothing."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: the place of each row in ``order``, from 1, with no task that sees all rows.

    Rows are dealt to the tasks by ranges and put in order there; each task's first
    number is the sum of the rows in those before it.
    """
    local = df.withColumns({f"_o{k}": c for k, c in enumerate(order)})
    keys = [f"_o{k}" for k in range(len(order))]
    placed = stage(local.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))  # a row a task
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_m", "_before")


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """Page ``number`` (from 1) of at most ``most`` rows; each row has the ``total`` of all pages."""
    number, size = max(1, number), min(max(1, size), most)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def page_before(df: DataFrame, time: str, key: str, before: tuple | None, size: int) -> DataFrame:
    """The ``size`` newest rows strictly older than ``before`` = (time, key); ``has_more`` tells of others."""
    if before is not None:
        t, k = F.lit(before[0]), F.lit(before[1])
        df = df.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    some = df.orderBy(F.desc(time), F.desc(key)).limit(size + 1)
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(time), F.desc(key))))  # size + 1 rows
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(1))) > size).filter(F.col("_n") <= size).drop("_n")


def free_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``unique_name``: the first of equal names keeps it, the others get the first free of -2, -3 ... behind it.

    A number is free if no row has the name with it. Per name, as many numbers are looked
    at as there are repeats and taken numbers. Null names stay null.
    """
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1)
    repeats = rows.groupBy(F.col(name).alias("_base")).agg(F.max("_n").alias("_most")).filter("_most > 0")
    numbered = df.select(F.regexp_extract(name, r"^(.*)-([1-9]\d{0,8})$", 1).alias("_base"), F.regexp_extract(name, r"^(.*)-([1-9]\d{0,8})$", 2).alias("_k")).filter("_k <> ''")
    taken = numbered.groupBy("_base").agg(F.collect_set(F.col("_k").cast("int")).alias("_taken"))
    most = F.col("_most").cast("int") + F.size("_taken")
    own = repeats.join(taken, "_base", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = own.select("_base", F.posexplode(F.array_except(F.sequence(F.lit(2), most + 2), "_taken")).alias("_n", "_k")).select(F.col("_base").alias(name), (F.col("_n") + 1).alias("_n"), "_k")
    return rows.join(free, [name, "_n"], "left").withColumn("unique_name", F.when(F.col("_k").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("-"), F.col("_k").cast("string")))).drop("_n", "_k")


def within_budget(df: DataFrame, order: list[Column], size: Column, each: int, total: int, files: int, group: str) -> DataFrame:
    """The first ``files`` rows a group, each cut to ``each`` and to what is left of ``total``; blank ones are passed over.

    Every task keeps only the first ``files`` rows of a group before they are shuffled.
    """
    first = keep_first(df.withColumn("_size", F.least(F.coalesce(size, F.lit(0)), F.lit(each))), [group], order, files)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(w), F.lit(0))
    rows = first.withColumn("used", F.least(F.col("_size"), F.lit(total) - before)).withColumn("running", F.least(before + F.col("_size"), F.lit(total)))
    return rows.filter("used > 0").drop("_size")


def natural_key(column: str) -> Column:
    """A text that sorts dotted numbers as numbers: segments padded to 8 digits; one with a bad segment comes last as a whole.

    A segment is a number from 0 to 2**64 - 1, blanks around it allowed.
    """
    parts = F.transform(F.split(F.trim(column), r"\."), lambda s: F.trim(s))
    number = lambda s: F.when(s.rlike(r"^\+?\d+$"), s.cast("decimal(38,0)"))
    good = F.forall(parts, lambda s: F.coalesce(number(s) < F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit(False)))
    digits = F.transform(parts, lambda s: number(s).cast("string"))
    key = F.array_join(F.transform(digits, lambda d: F.when(F.char_length(d) < 8, F.lpad(d, 8, "0")).otherwise(d)), ".")
    return F.when(good, key).otherwise("99999999")


def page_slice(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number``, counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the parts; of equal keys those of the first part that has them. ``place`` is its number."""
    numbered_ = [p.withColumn("place", F.lit(k)) for k, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), numbered_)
    first = both.groupBy(*keys).agg(F.min("place").alias("place"))
    return both.join(first, [*keys, "place"], "left_semi").dropDuplicates(keys)


def claim(tasks: DataFrame, pending: Column, paused: DataFrame, tag: str, order: list[Column]) -> DataFrame:
    """The first pending task in order whose tag isn't paused; one row or none."""
    return tasks.filter(pending).join(paused.filter(F.col(tag).isNotNull()).distinct(), tag, "left_anti").orderBy(*order).limit(1)
