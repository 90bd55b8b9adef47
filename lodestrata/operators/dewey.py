"""Nested records as related flat tables, linked by Dewey labels.

Every node of a record gets the path of its ordinals as label (``2.0.4``); the
parent's label is the label cut at its last point. Nodes that share a schema path
(``records[].fields[]``) form one flat table.

Columns with a static type are taken apart by generators in the JVM, one per
nesting level. JSON text has no type: its nesting is known only row by row and
may differ from row to row, which built-in operators cannot recurse into, so it
is walked once, Arrow batch by Arrow batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import ship

NODE_SCHEMA = "owner STRING, path STRING, dewey STRING, ordinal INT, name STRING, kind STRING, value STRING, attributes MAP<STRING,STRING>"
#: Nodes in one Arrow batch that leaves the walker.
BATCH_NODES = 20_000


def parent_label(dewey: Column) -> Column:
    """The label of the parent: cut at the last point, null at the top."""
    return F.when(dewey.contains("."), F.regexp_replace(dewey, r"\.[^.]*$", ""))


def nested_paths(kind: T.DataType, at: str = "") -> list[tuple[str, T.DataType]]:
    """The repeated elements (arrays and maps) inside a type, outermost first: schema path and element type."""
    if isinstance(kind, T.ArrayType):
        return [(f"{at}[]", kind.elementType), *nested_paths(kind.elementType, f"{at}[]")]
    if isinstance(kind, T.MapType):
        return [(f"{at}{{}}", kind.valueType), *nested_paths(kind.valueType, f"{at}{{}}")]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in nested_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return []


def shred(df: DataFrame, owner: Column, column: str) -> dict[str, DataFrame]:
    """Flat tables of a typed nested column, by schema path.

    Each table has owner, dewey, parent, ordinal (place from 0; nulls count for
    the place), name (a map's key, else null) and ``node`` (the element, null
    elements included). A null or empty container has no rows. The plans are
    lazy: a table that is not used costs nothing, and column pruning reaches the
    scan.
    """
    root = df.select(owner.cast("string").alias("owner"), F.lit(None).cast("string").alias("dewey"), F.col(column).alias("node"))
    tables: dict[str, DataFrame] = {}

    def descend(rows: DataFrame, node: Column, kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                descend(rows, node.getField(f.name), f.dataType, f"{at}.{f.name}")
        elif isinstance(kind, T.ArrayType | T.MapType):
            mapped = isinstance(kind, T.MapType)
            label = F.concat_ws(".", "parent", F.col("ordinal").cast("string"))
            inner = rows.select("owner", F.col("dewey").alias("parent"), F.posexplode(F.map_entries(node) if mapped else node).alias("ordinal", "entry"))
            inner = inner.select(
                "owner", label.alias("dewey"), "ordinal",
                (F.col("entry.key").cast("string") if mapped else F.lit(None).cast("string")).alias("name"),
                (F.col("entry.value") if mapped else F.col("entry")).alias("node"),
            )
            path = f"{at}{'{}' if mapped else '[]'}"
            tables[path] = inner.select("owner", "dewey", parent_label(F.col("dewey")).alias("parent"), "ordinal", "name", "node")
            descend(inner.select("owner", "dewey", "node"), F.col("node"), kind.valueType if mapped else kind.elementType, path)

    descend(root, F.col("node"), df.schema[column].dataType, column)
    return tables


def shred_json(df: DataFrame, owner: Column, text: Column, paths: str | None = None, attributes: list[str] | None = None) -> DataFrame:
    """Nodes of JSON text: every array element and every container, with its scalar attributes; one walk over each text.

    ``paths`` (a pattern for the schema path) and ``attributes`` say which nodes and
    attributes leave the walk, by default all.

    ``path`` is the schema path: ``[]`` for an element, ``.name`` for a member,
    digits at the end of a name read ``#`` (``column_7`` is ``column_#``). A lone
    object at the top counts as an array of one. JSON inside a string that is an
    object or array is unwrapped in place. ``kind`` is object, array, scalar or
    null; ``attributes`` holds an object's scalar members, ``value`` a scalar's
    text. Null, empty and unreadable text give no nodes.
    """
    source = df.select(owner.cast("string").alias("owner"), text.cast("string").alias("text")).where(F.col("text").isNotNull())
    ship(df.sparkSession)
    nodes = source.mapInArrow(partial(_walk_batches, paths=paths, attributes=attributes), NODE_SCHEMA)
    return nodes.withColumn("parent", parent_label(F.col("dewey")))


def _walk_batches(batches: Iterator[pa.RecordBatch], paths: str | None, attributes: list[str] | None) -> Iterator[pa.RecordBatch]:
    names = ["owner", "path", "dewey", "ordinal", "name", "kind", "value", "attributes"]
    kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string())]
    pattern, wanted = re.compile(paths or ""), None if attributes is None else set(attributes)
    leaves = cache(lambda path: bool(pattern.search(path)))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _walk(owner, text, out, leaves, wanted)
            if len(out) >= BATCH_NODES:
                yield flush()
    if out:
        yield flush()


_DIGITS = re.compile(r"\d+$")


def _unwrap(value):
    """Containers inside strings, however deep they are wrapped."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        if not isinstance(inner, dict | list | str) or inner == value:
            return value
        value = inner
    return value


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _walk(owner: str | None, text: str, out: list[tuple], leaves: Callable[[str], bool], wanted: set[str] | None) -> None:
    try:
        top = _unwrap(json.loads(text))
    except (ValueError, RecursionError):
        return
    if isinstance(top, dict):
        top = [top]
    if not isinstance(top, list):
        return
    stack = [(v, "[]", str(i), i, None) for i, v in enumerate(top)]
    stack.reverse()
    while stack:
        value, path, dewey, ordinal, name = stack.pop()
        value = _unwrap(value)
        leaving = leaves(path)
        if isinstance(value, dict):
            scalars, inner = [], []
            for i, (k, v) in enumerate(value.items()):
                v = _unwrap(v)
                # members of a keyed container (column_1, column_2, ...) are rows, not attributes
                if isinstance(v, dict | list) or _DIGITS.search(k):
                    inner.append((v, f"{path}.{_DIGITS.sub('#', k)}", f"{dewey}.{i}", i, k))
                elif leaving and (wanted is None or k in wanted):
                    scalars.append((k, _scalar(v)))
            if leaving:
                out.append((owner, path, dewey, ordinal, name, "object", None, scalars))
            stack.extend(reversed(inner))
        elif isinstance(value, list):
            if leaving:
                out.append((owner, path, dewey, ordinal, name, "array", None, None))
            stack.extend((v, f"{path}[]", f"{dewey}.{i}", i, None) for i, v in reversed(list(enumerate(value))))
        elif leaving:
            out.append((owner, path, dewey, ordinal, name, "null" if value is None else "scalar", _scalar(value), None))
