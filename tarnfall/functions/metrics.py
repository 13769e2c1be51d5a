"""Evaluation metrics over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_recall(hits: str, truth: str) -> Column:
    """1 if any true id is among the hits; 0 for an empty truth."""
    return F.coalesce(F.arrays_overlap(hits, truth), F.lit(False)).cast("int")


def hit_count(hits: str, truth: str) -> Column:
    return F.size(F.array_intersect(hits, truth))


def recall(hits: str, truth: str) -> Column:
    return F.when(F.size(truth) == 0, 0.0).otherwise(F.size(F.array_intersect(hits, truth)) / F.size(truth))


def ndcg(hits: str, truth: str, k: int) -> Column:
    """Discounted gain of the first ``k`` hits over that of the true order.

    A hit's gain is 1 / its place in ``truth``, 0 if it isn't there; both are arrays of
    ids in order. 0 if either is empty.
    """
    n = F.least(F.lit(k), F.size(hits), F.size(truth))
    gain = lambda x: F.when(F.array_position(truth, x) > 0, 1 / F.array_position(truth, x)).otherwise(0.0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    found = total(F.transform(F.slice(hits, 1, n), lambda x, i: gain(x) / F.log2(i + 2.0)))
    best = total(F.transform(F.sequence(F.lit(1), n), lambda i: 1 / i / F.log2(i + 1.0)))
    return F.when(n > 0, found / best).otherwise(0.0)


def f1(true: Column, found: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts; 0 where a denominator is 0."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(true, found), over(true, expected)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
