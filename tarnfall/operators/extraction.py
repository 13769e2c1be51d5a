"""Mentions of entities in texts, and events out of what a model answered."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.operators.retrieval import chunk_spans

# Times, in this order.
TIMES = (
    r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日",
    r"\d{4}-\d{1,2}-\d{1,2}",
    "今天|明天|昨天|后天|前天|去年|今年|明年|现在|刚才",
)
# Numbers, in this order.
NUMBERS = (
    r"\d+(?:\.\d+)?\s*(?:元|个|名|位|次|%|岁|年|月|天|件|台|套|本|页|字|斤|公斤|吨|米|公里|秒|分|时)",
    r"\d+(?:\.\d+)?%",
    r"\d+",
)
# Fixed value: subject, verb and object of a plain sentence.
SENTENCE = r"(.{1,20})(?:去|到|在|见|会)(.{1,20})"
OTHER = "其他"
#: Most characters of all dictionary words together; a task's automaton takes some fifty bytes for each.
MAX_DICTIONARY = 20_000_000
#: Of words of several kinds the first of these holds.
KINDS = ("PERSON", "ORGANIZATION", "LOCATION")

_TIMES, _NUMBERS, _SENTENCE = [re.compile(p) for p in TIMES], [re.compile(p) for p in NUMBERS], re.compile(SENTENCE)
Mention = tuple[str, str, int, int]


def automaton(words: list[tuple[str, str]]):
    """A matcher of the dictionary's words; None for an empty one."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind in reversed(KINDS):
        for k, w in words:
            if k == kind and w:
                a.add_word(w, (kind, w))
    for k, w in words:
        if k not in KINDS and w and w not in a:
            a.add_word(w, (k, w))
    if not len(a):
        return None
    a.make_automaton()
    return a


def mentions_of(text: str, words) -> list[Mention]:
    """(type, text, start, end) in order: times, then numbers, then the dictionary's longest words, none over another.

    Places count characters. A word of letters doesn't begin or end inside a longer one.
    """
    taken = bytearray(len(text))
    out: list[Mention] = []

    def take(kind: str, lo: int, hi: int) -> None:
        if not any(taken[lo:hi]):
            taken[lo:hi] = b"\x01" * (hi - lo)
            out.append((kind, text[lo:hi], lo, hi))

    for kind, patterns in (("TIME", _TIMES), ("NUMBER", _NUMBERS)):
        for p in patterns:
            for m in p.finditer(text):
                take(kind, *m.span())
    if words is not None:
        joined = lambda k: 0 < k < len(text) and text[k - 1].isascii() and text[k].isascii() and text[k - 1].isalnum() and text[k].isalnum()
        for end, (kind, w) in words.iter_long(text):
            lo, hi = end + 1 - len(w), end + 1
            if not joined(lo) and not joined(hi):
                take(kind, lo, hi)
    return sorted(out, key=lambda m: m[2:])


def _dictionary(words: DataFrame):
    """Words ``kind, word``, measured before they are sent to the tasks."""
    own = words.select("kind", "word").filter("word <> ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.char_length("word").cast("long")), F.lit(0))).first()[0]
    if size > MAX_DICTIONARY:
        raise ValueError(f"the dictionary holds {size} characters, more than MAX_DICTIONARY = {MAX_DICTIONARY}; split it")
    return words.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in own.collect()))


_FIELDS = [("place", pa.int32()), ("kind", pa.string()), ("mention", pa.string()), ("start", pa.int32()), ("end", pa.int32())]


def mentions(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``key, place, kind, mention, start, end``: all mentions of each text, numbered in order; null texts have none."""
    dictionary = _dictionary(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(dictionary.value)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, m in enumerate(mentions_of(t, found)):
                    at.append(i)
                    rows.append((n, *m))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS))], names=[key, *(n for n, _ in _FIELDS)])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, place int, kind string, mention string, start int, end int")


def repaired(text: str) -> str:
    """JSON out of an answer: without fences and what stands around the outermost object or array, without commas before a closing bracket."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text)
    starts, ends = [k for k in (body.find("{"), body.find("[")) if k >= 0], max(body.rfind("}"), body.rfind("]"))
    body = body[min(starts) : ends + 1] if starts and ends >= 0 else body
    return re.sub(r",\s*([}\]])", r"\1", body)


def _events(text: str) -> list[dict] | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    rows = value.get("events") if isinstance(value, dict) else None
    return [e for e in rows if isinstance(e, dict)] if isinstance(rows, list) else None


def answer_events(answer: str, chunk: str, words=None) -> list[tuple[str, str, str, list[str], str]]:
    """(title, summary, category, keywords, level) of each event in an answer about a chunk.

    The first level that gives something holds: the JSON as it is, the repaired JSON, a
    plain sentence, else one event with the chunk's own mentions as keywords. A blank
    answer gives none.
    """
    if not answer.strip():
        return []
    for level, text in (("strict", answer), ("repaired", repaired(answer))):
        rows = _events(text)
        if rows is not None:
            word = lambda e, k: e.get(k) if isinstance(e.get(k), str) else ""
            return [(word(e, "title"), word(e, "summary"), word(e, "category") or OTHER, [k for k in e.get("keywords") or [] if isinstance(k, str)], level) for e in rows]
    m = _SENTENCE.search(answer)
    if m:
        return [(m[1] + m[2], chunk[:50], OTHER, [m[1], m[2]], "sentence")]
    return [(chunk[:50], chunk[:50], OTHER, [t for _, t, _, _ in mentions_of(chunk, words)][:5], "mentions")]


def extracted_events(df: DataFrame, key: str, text: str, words: DataFrame, answer: str | None = None, size: int = 500, overlap: int = 50) -> DataFrame:
    """``key, chunk_idx, place, title, category, keywords, level``: events of every chunk, in the order of the chunks.

    ``answer`` names a column with a model's answer about the whole text, which is read
    instead of asking a model; without one every chunk falls back to its mentions.
    """
    dictionary = _dictionary(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(dictionary.value)
        for b in batches:
            at, rows = [], []
            answers = b.column(2).to_pylist()
            for i, t in enumerate(b.column(1).to_pylist()):
                for c, (lo, hi) in enumerate(chunk_spans(t, "\n\n", size, overlap)):
                    for n, (title, _, category, keywords, level) in enumerate(answer_events(answers[i] or "?", t[lo:hi], found)):
                        at.append(i)
                        rows.append((c, n, title, category, keywords, level))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, "chunk_idx", "place", "title", "category", "keywords", "level"])

    kind = df.schema[key].dataType.simpleString()
    given = F.lit(None).cast("string") if answer is None else F.col(answer)
    return df.select(key, text, given.alias("_answer")).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, chunk_idx int, place int, title string, category string, keywords array<string>, level string")
