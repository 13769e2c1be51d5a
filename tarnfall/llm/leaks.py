"""Evaluation texts that leaked into a corpus.

The items' normalised character n-grams form a hash set that every task holds; the
corpus is scanned once, all windows of each text are hashed by a rolling hash, looked up,
and every hit is verified on the characters. There is no shuffle but for the final
distinct. The set's size is checked: items beyond ``max_gram_chars`` are refused, as a
held-out set of that size should be split into several calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.llm.codes import Rolling, joined, letters
from tarnfall.llm.visual import plain_forms, skeleton

#: Window widths by the item's language: a run at least this long counts as a leak.
WIDTHS = {"en": 50, "zh": 16}
#: The same for items of any other language, or none.
OTHER_WIDTH = 50
#: Most characters of all items together: 12 bytes each in every Python worker.
MAX_GRAM_CHARS = 20_000_000

_BITS = 22


def _lowered(text: str) -> str:
    return skeleton(text).lower().replace("ς", "σ").replace("\x00", " ")


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case letters and digits in one form, joined; and the starts of the texts."""
    codes, starts = joined([_lowered(t) for t in texts])
    keep = letters()[codes]  # separators count, so that texts stay apart
    moved = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(keep, out=moved[1:])
    return codes[keep], moved[starts]


class Grams:
    """The hash set of all windows of the items, for each width."""

    def __init__(self, items: list[tuple[int, str, str]], widths: dict[str, int]):
        self.sets = []
        for width in sorted({*widths.values(), OTHER_WIDTH}):
            own = [(i, t) for i, lang, t in items if widths.get(lang, OTHER_WIDTH) == width]
            codes, starts = reduced([t for _, t in own])
            hashes = Rolling(codes).windows(width)
            item = np.repeat(np.arange(len(own)), np.diff(starts))[: len(hashes)]
            inside = np.arange(len(hashes)) + width < starts[1:][item] if len(own) else np.zeros(0, dtype=bool)
            places = np.flatnonzero(inside)
            places = places[np.argsort(hashes[places], kind="stable")]
            bitmap = np.zeros(1 << _BITS, dtype=bool)
            bitmap[(hashes[places] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.sets.append((width, np.array([i for i, _ in own], dtype=np.int64), codes, item, places, hashes[places], bitmap))

    def hits(self, codes: np.ndarray, rolling: Rolling) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, places in ``codes``, item ids) of all verified hits."""
        for width, ids, item_codes, item, places, hashes, bitmap in self.sets:
            windows = rolling.windows(width)
            maybe = np.flatnonzero(bitmap[(windows >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo = np.searchsorted(hashes, windows[maybe], "left")
            hi = np.searchsorted(hashes, windows[maybe], "right")
            n = hi - lo
            at = np.repeat(maybe, n)
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            there = places[which]
            right = np.ones(len(at), dtype=bool)
            for k in range(width):  # the characters themselves
                right &= codes[at + k] == item_codes[there + k]
            yield width, at[right], ids[item[there[right]]]


def _collect_items(items: DataFrame, max_gram_chars: int) -> list[tuple[int, str, str]]:
    wanted = items.filter(F.col("text").isNotNull()).select("item_id", "lang", "text").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    if size > max_gram_chars:
        raise ValueError(f"the items hold {size} characters, more than max_gram_chars = {max_gram_chars}; split them")
    return [(r[0], r[1], r[2]) for r in wanted.collect()]


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", widths: dict[str, int] | None = None, max_gram_chars: int = MAX_GRAM_CHARS) -> DataFrame:
    """``doc_id, item_id``: documents that share a run of letters and digits with an item.

    ``widths`` gives the least run by the items' ``lang``, ``OTHER_WIDTH`` that of others;
    items without text or shorter than a run match nothing. Null and empty documents match
    nothing. Repeated rows give one result.
    """
    widths = widths or WIDTHS
    found = documents.sparkSession.sparkContext.broadcast(_collect_items(items, max_gram_chars))
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(found.value, widths)
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                codes, starts = reduced(b.column(1).to_pylist())
                doc, item = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for _, at, ids in grams.hits(codes, Rolling(codes)):
                    doc.append(np.searchsorted(starts, at, "right") - 1)
                    item.append(ids)
                both = np.unique(np.stack([np.concatenate(doc), np.concatenate(item)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both[0])), pa.array(both[1])], names=["doc_id", "item_id"])

    texts = documents.select(F.col(id_column), F.col(text_column)).filter(F.col(text_column).isNotNull())
    return texts.mapInArrow(run, f"doc_id {kind}, item_id long").distinct()


def _clusters(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` that normalise on their own: a character with the marks and unseen ones behind it."""
    import unicodedata

    start = 0
    for k in range(1, len(text) + 1):
        if k == len(text) or not (unicodedata.combining(text[k]) or plain_forms(text[k]) == ""):
            yield start, k
            start = k


def cut_spans(text: str, grams: Grams) -> tuple[str, int]:
    """``text`` without the stretches that stand in an item, and how many characters went."""
    places: list[tuple[int, int]] = []
    chars: list[str] = []
    for lo, hi in _clusters(text):
        for c in _lowered(text[lo:hi]):
            if c.isalnum():
                chars.append(c)
                places.append((lo, hi))
    codes = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    gone = np.zeros(len(text) + 1, dtype=bool)
    for width, at, _ in grams.hits(codes, Rolling(codes)):
        for k in np.unique(at).tolist():
            gone[places[k][0] : places[k + width - 1][1]] = True
    if not gone.any():
        return text, 0
    kept = "".join(c for c, g in zip(text, gone) if not g)
    return kept, len(text) - len(kept)


def without_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", widths: dict[str, int] | None = None, max_gram_chars: int = MAX_GRAM_CHARS) -> DataFrame:
    """``doc_id, text, cut_chars`` of every document: leaked spans are cut out of the stored text.

    Texts without a leak stay as they are; null stays null with 0 cut. One row per input row.
    """
    widths = widths or WIDTHS
    found = documents.sparkSession.sparkContext.broadcast(_collect_items(items, max_gram_chars))
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(found.value, widths)
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                texts = b.column(1).to_pylist()
                codes, starts = reduced([t or "" for t in texts])
                hit = {int(d) for _, at, _ in grams.hits(codes, Rolling(codes)) for d in np.unique(np.searchsorted(starts, at, "right") - 1)}
                done = [cut_spans(t, grams) if k in hit else (t, 0) for k, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["doc_id", "text", "cut_chars"])

    return documents.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, text string, cut_chars long")
