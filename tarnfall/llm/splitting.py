"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is taken apart into atomic segments (sentences and lines; where one is too long
by itself, its clauses, words, or at last bare stretches). The boundaries between
neighbours lie in a heap, weakest first; the segments on both sides of the weakest one
are merged as long as the result, with the overlap in front of it, stays within the
limit. What remains are the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Every place where a text could be cut: a run of white space, or wide punctuation without any behind it.
_PLACE = re.compile(r"\s+|[。！？…]+[”’」』）]*(?=\S)|[，；：、](?=\S)")
_PART = re.compile(r"#|\d+[.)]\s|[-*•]\s")
_CLOSING = "\"'”’»)]」』）"
_SENTENCE = 3


def _joins(text: str, at: int) -> bool:
    """Whether the characters on both sides of ``at`` print as one."""
    c, before = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in "‍️" or before == "‍" or (before == "\r" and c == "\n")


def _strength(text: str, m: re.Match) -> int:
    """6 a blank line before a heading or list, 5 a blank line, 4 a line's end, 3 a sentence's, 2 a clause's, 1 a word's."""
    if not m[0][0].isspace():
        return 2 if m[0] in "，；：、" else 3
    lines = m[0].count("\n")
    if lines:
        return 4 if lines == 1 else 6 if _PART.match(text, m.end()) else 5
    at = m.start() - 1
    while at > 0 and at > m.start() - 4 and text[at] in _CLOSING:
        at -= 1
    return 3 if text[at] in ".!?…。！？" else 2 if text[at] in ",;:–—，；：、" else 1


def boundaries(text: str, largest: int) -> list[tuple[int, int]]:
    """(place, strength) of all cuts into atomic segments of at most ``largest`` characters.

    Sentences and larger parts are always cut; clauses, words and at last single
    characters only where a segment is too long otherwise.
    """
    n = len(text)
    places = [(m.end(), _strength(text, m)) for m in _PLACE.finditer(text) if m.end() < n]
    cuts = [p for p in places if p[1] >= _SENTENCE]
    for level in range(_SENTENCE - 1, 0, -1):
        ends = [0, *(p for p, _ in cuts), n]
        long = [(lo, hi) for lo, hi in zip(ends, ends[1:]) if hi - lo > largest]
        if not long:
            return cuts
        at, more = 0, []
        for place in places:
            while at < len(long) and long[at][1] <= place[0]:
                at += 1
            if at == len(long):
                break
            if place[1] == level and place[0] > long[at][0]:
                more.append(place)
        cuts = sorted(cuts + more)
    ends, bare = [0, *(p for p, _ in cuts), n], []
    for lo, hi in zip(ends, ends[1:]):
        at = lo + largest
        while at < hi:
            floor = at - largest // 2
            while at > floor and _joins(text, at):
                at -= 1
            bare.append((at, 0))
            at += largest
    return sorted(cuts + bare)


def split_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces begin, 0 first; each piece with its overlap has at most ``limit`` characters."""
    n = len(text)
    if n <= limit:
        return [0] if n else []
    body = limit - overlap
    cuts = boundaries(text, body)
    start = [0, *(p for p, _ in cuts)]
    end = [*start[1:], n]
    strength = [9, *(s for _, s in cuts)]
    before, after = list(range(-1, len(start) - 1)), [*range(1, len(start)), -1]
    version = [0] * len(start)

    def room(k: int) -> int:
        return limit if start[k] == 0 else body

    heap = [(strength[k], end[k] - start[k - 1], k, 0, 0) for k in range(1, len(start))]
    heapq.heapify(heap)
    while heap:
        _, _, k, left_version, own_version = heapq.heappop(heap)
        j = before[k]
        if version[k] != own_version or version[k] < 0 or version[j] != left_version:
            continue
        if end[k] - start[j] > room(j):
            continue  # both sides only grow, so it never fits later
        end[j] = end[k]
        after[j] = after[k]
        version[k] = -1
        version[j] += 1
        if after[j] >= 0:
            r = after[j]
            before[r] = j
            heapq.heappush(heap, (strength[r], end[r] - start[j], r, version[j], version[r]))
        if before[j] >= 0:
            heapq.heappush(heap, (strength[j], end[j] - start[before[j]], j, version[before[j]], version[j]))
    points = [start[k] for k in range(len(start)) if version[k] >= 0]
    if len(points) > 1 and points[1] < overlap:  # the second piece must find its whole overlap
        inner = [s for s in start if overlap <= s <= limit and s < (points[2] if len(points) > 2 else n)]
        points[1] = inner[0] if inner else overlap
        if len(points) > 2 and points[1] >= points[2]:
            del points[1]
    return points


_PIECES = "event_id string, chunk_id string, position int, start long, end long, piece string"


def pieces(df: DataFrame, id_column: str, chunk_column: str, text_column: str, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """``event_id, chunk_id, position, start, end, piece`` of all texts over ``limit`` characters.

    ``position`` counts from 0; ``start`` and ``end`` are places in the text, the overlap
    included: each piece but the first begins ``overlap`` characters before the end of
    the one before it. Joined without their overlaps the pieces give the text again.
    Null, empty and short texts give nothing. Equal repeated rows count once.
    """
    if not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be at most a third of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for event, chunk, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                points = split_points(text, limit, overlap)
                for k, (lo, hi) in enumerate(zip(points, [*points[1:], len(text)])):
                    lo = max(0, lo - overlap)
                    for column, x in zip(out, (event, chunk, k, lo, hi, text[lo:hi])):
                        column.append(x)
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["event_id", "chunk_id", "position", "start", "end", "piece"])

    long = df.select(F.col(id_column).cast("string").alias("a"), F.col(chunk_column).cast("string").alias("b"), F.col(text_column).alias("c")).filter(F.char_length("c") > limit).distinct()
    return long.mapInArrow(run, _PIECES)
