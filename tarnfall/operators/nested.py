"""Nested JSON to flat tables by interval labels.

A depth-first walk numbers every object and array of a record twice: in the order in
which they are entered (``pre``) and left (``post``). Node ``a`` encloses node ``b`` of
the same record exactly if ``a.pre < b.pre`` and ``a.post > b.post``, so the tables made
per node type are linked to each other by these two numbers, whatever the depth, and
without a walk over paths.

The walk needs the whole record and nothing else: it runs in Arrow batches inside the
scan's own tasks, with no shuffle. JSON of unknown shape can't be walked by built-in
expressions, which want a schema or one call per level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S)

NODE_SCHEMA = "record_id string, node_type string, node_path string, parent_path string, pre int, post int, depth int, in_array boolean, attrs map<string,string>"
LINK_SCHEMA = "record_id string, node_path string, parent_path string"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_json(text: str):
    """``text`` as strict JSON (no NaN or Infinity); ValueError if it isn't.

    Any nesting depth and any length of number is allowed.
    """
    try:
        return json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError:
        raise
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        if "integer string" in str(e):
            return json.loads(text, parse_constant=_no_constant, parse_int=float)
        raise


def _parse_deep(text: str):
    """A parser without recursion, for nesting that exceeds the standard one's stack."""
    at, end, root = 0, len(text), []
    stack: list = [root]
    keys: list = [None]
    expect = "value"  # value, value-or-end, comma, key, key-or-end, colon, done
    while True:
        if not text[at:].strip(" \t\n\r") if end - at < 64 else False:
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, string, other = m.groups()
        top = stack[-1]
        if mark in ("]", "}"):
            if len(stack) == 1 or (mark == "]") != isinstance(top, list) or expect not in ("comma", "value-or-end" if mark == "]" else "key-or-end"):
                raise ValueError(f"no JSON at {at}")
            stack.pop()
            keys.pop()
            expect = "done" if len(stack) == 1 else "comma"
        elif mark == ",":
            if expect != "comma":
                raise ValueError(f"no JSON at {at}")
            expect = "value" if isinstance(top, list) else "key"
        elif mark == ":":
            if expect != "colon":
                raise ValueError(f"no JSON at {at}")
            expect = "value"
        elif expect in ("key", "key-or-end"):
            if string is None:
                raise ValueError(f"no JSON at {at}")
            keys[-1] = json.loads(string)
            expect = "colon"
        elif expect in ("value", "value-or-end"):
            value = [] if mark == "[" else {} if mark == "{" else json.loads(string or other)
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
            if mark:
                stack.append(value)
                keys.append(None)
                expect = "value-or-end" if mark == "[" else "key-or-end"
            else:
                expect = "done" if len(stack) == 1 else "comma"
        else:
            raise ValueError(f"no JSON at {at}")
    if expect != "done":
        raise ValueError("JSON ends early")
    return root[0]


def _opened(value):
    """What a text value counts as: the object or array that it holds, else itself."""
    seen = value
    while isinstance(seen, str):
        head = seen.lstrip(" \t\n\r")[:1]
        if head not in ("{", "[", '"') or not head:
            return value
        try:
            seen = parse_json(seen)
        except ValueError:
            return value
    return seen if isinstance(seen, (dict, list)) else value


def label_nodes(document) -> list[list]:
    """Nodes in pre-order: [pre, post, depth, parent node, step from it, in_array, value].

    The walk keeps its own stack and nodes hold no paths, so depth is bounded by memory only.
    """
    nodes: list[list] = []
    pre = post = 0
    stack: list = [(document, None, "$", False, 0)]
    while stack:
        item = stack.pop()
        if len(item) == 1:
            item[0][1] = post
            post += 1
            continue
        value, parent, step, in_array, depth = item
        if isinstance(value, str):
            value = _opened(value)
        node = [pre, 0, depth, parent, step, in_array, value]
        if isinstance(value, dict):
            children = [(v, node, f".{k}", False, depth + 1) for k, v in value.items() if isinstance(v, (dict, list, str))]
        elif isinstance(value, list):
            children = [(v, node, f"[{i}]", True, depth + 1) for i, v in enumerate(value) if isinstance(v, (dict, list, str))]
        else:
            continue
        nodes.append(node)
        pre += 1
        stack.append((node,))
        stack.extend(reversed(children))
    return nodes


def path_of(node: list | None, positions: bool = True) -> str:
    """The node's path from ``$``; without positions it names the node's type."""
    steps = []
    while node is not None:
        steps.append(node[4] if positions or not node[5] else "[]")
        node = node[3]
    return "".join(reversed(steps)) or "$"


def enclosing_cases(nodes: list[list]) -> Iterator[tuple[list, list | None]]:
    """Each case (an object that is an array's element) with the nearest case around it.

    Nodes come in pre-order; those that enclose the present one are the ones on the
    stack with a larger ``post``.
    """
    around: list[list] = []
    for node in nodes:
        if not node[5] or not isinstance(node[6], dict):
            continue
        while around and around[-1][1] < node[1]:
            around.pop()
        yield node, around[-1] if around else None
        around.append(node)


def _scalar(value) -> str | None:
    return value if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False)


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can escape and UTF-8 can't hold, become '?'."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _batches(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(9 if full else 3)]
            for rid, text in zip(ids, texts):
                if text is None:
                    continue
                try:
                    nodes = label_nodes(parse_json(text))
                except ValueError:
                    continue
                if not full:
                    for node, parent in enclosing_cases(nodes):
                        out[0].append(rid)
                        out[1].append(_clean(path_of(node)))
                        out[2].append(_clean(path_of(parent)))
                    continue
                parents = {n[0]: p for n, p in enclosing_cases(nodes)}
                for n in nodes:
                    value = n[6]
                    attrs = [(_clean(k), None if v is None else _clean(_scalar(v))) for k, v in value.items() if not isinstance(v, (dict, list)) and not (isinstance(v, str) and not isinstance(_opened(v), str))] if isinstance(value, dict) else []
                    for column, x in zip(out, (rid, _clean(path_of(n, False)), _clean(path_of(n)), _clean(path_of(parents[n[0]])) if n[0] in parents else None, n[0], n[1], n[2], n[5], attrs)):
                        column.append(x)
            if full:
                types = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.map_(pa.string(), pa.string())]
                names = ["record_id", "node_type", "node_path", "parent_path", "pre", "post", "depth", "in_array", "attrs"]
            else:
                types, names = [pa.string()] * 3, ["record_id", "node_path", "parent_path"]
            for lo in range(0, max(1, len(out[0])), 20_000):  # a batch of small records may hold many nodes
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 20_000], t) for c, t in zip(out, types)], names=names)

    return run


def node_table(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """All objects and arrays of a JSON column, with their interval labels.

    One row a node: ``record_id, node_type`` (the path without positions), ``node_path,
    parent_path`` (of the nearest enclosing array element; null unless the node is one
    itself), ``pre, post, depth, in_array, attrs`` (the scalar members).

    Null, empty and invalid text gives no rows; text holding JSON counts as what it
    holds; members with one name in one object: the last holds; numbers keep their text
    only in ``attrs``. Repeated records give repeated rows. Other columns are ignored.
    """
    return df.select(F.col(id_column).cast("string").alias("record_id"), F.col(json_column).alias("_json")).mapInArrow(_batches(True), NODE_SCHEMA)


def element_links(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Every object that is an array's element: ``record_id, node_path, parent_path``.

    The rows of :func:`node_table` that have a parent_path, without the columns that
    cost time to make.
    """
    return df.select(F.col(id_column).cast("string").alias("record_id"), F.col(json_column).alias("_json")).mapInArrow(_batches(False), LINK_SCHEMA)


def type_table(nodes: DataFrame, node_type: str, attributes: list[str]) -> DataFrame:
    """The flat table of one node type: its keys, labels and the named attributes as columns."""
    return nodes.filter(F.col("node_type") == node_type).select("record_id", "node_path", "pre", "post", *[F.col("attrs")[a].alias(a) for a in attributes])


def contained_in(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Link two flat tables by containment: each child with every parent around it.

    Adds ``parent_pre``. An equi-join on the record, so its size is that of the children
    times the nesting depth of the parents' type.
    """
    p = parents.select("record_id", F.col("pre").alias("parent_pre"), F.col("post").alias("_post"))
    inside: list[Column] = [F.col("parent_pre") < F.col("pre"), F.col("_post") > F.col("post")]
    return children.join(p, "record_id").filter(reduce(lambda a, b: a & b, inside)).drop("_post")
