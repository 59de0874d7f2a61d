"""Deeply nested semi-structured records to related flat tables.

Method: each JSON text is read by a streaming tokenizer with an explicit stack
(no tree is built, nesting depth is unbounded) that emits path-value-ordinal
triples; paths are grouped by their nearest repeated ancestor; each group is
pivoted into one table whose rows keep the key of their parent row.

A record's triples come out one after the other, so they are grouped and pivoted
in the task that reads it, without a shuffle and without a second scan; the rows
of all tables are written once, in one folder per table.

A path is written with ``[]`` for an array level and ``{}`` for a map level, e.g.
``changes[].patches[].file_path``.  The ordinals are the positions and map keys
on the way, so a row's key is its ordinals and its parent's key their prefix.
A single value where other records have an array counts as position 0.

Defined results
* null or empty text gives no triples; a text that is no JSON gives one triple
  with path ``!error``, its value telling the offset, and nothing else;
* null values give a triple of kind ``null``, so that positions can be counted;
  empty arrays and objects give a triple of kind ``empty_array`` or ``empty_object``;
* repeated keys of one object are all emitted, in order; in a table the last one
  stands in its column, earlier ones in ``overwritten``;
* repeated records are told apart by the record id the caller gives.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch

TRIPLES = "path string, ordinals array<string>, kind string, value string"
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]|\\.)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.S)


def stream(text: str, map_paths: frozenset[str] = frozenset()) -> Iterator[tuple[str, tuple[str, ...], str, str | None]]:
    """(path, ordinals, kind, value) of every leaf of a JSON text, in order.

    The members of an object at one of ``map_paths`` are entries of a map: their
    keys go to the ordinals and the path continues with ``{}``.  Raises ValueError
    with the offset where the text stops being JSON.
    """
    match, at, size = _TOKEN.match, 0, len(text)
    # a frame: [is_object, path, ordinals, next position or pending key, is_map, count]
    stack: list[list] = []
    expect = "value"  # value, value_or_end, key, key_or_end, colon, comma_or_end, done
    while True:
        m = match(text, at)
        if m is None:
            if text[at:].strip() or expect != "done":
                raise ValueError(f"no JSON at {at}")
            return
        if expect == "done":
            raise ValueError(f"text after the value at {at}")
        at = m.end()
        which = m.lastindex
        mark = m.group(1) if which == 1 else None
        if expect in ("key", "key_or_end"):
            if which == 2:
                key = m.group(2)
                stack[-1][3] = json.loads(f'"{key}"') if "\\" in key else key
                expect = "colon"
                continue
            if mark == "}" and expect == "key_or_end":
                frame = stack.pop()
                yield frame[1], frame[2], "empty_object", None
                expect = "comma_or_end" if stack else "done"
                continue
            raise ValueError(f"no key at {m.start()}")
        if expect == "colon":
            if mark != ":":
                raise ValueError(f"no colon at {m.start()}")
            expect = "value"
            continue
        if expect == "comma_or_end":
            frame = stack[-1]
            if mark == ",":
                if not frame[0]:
                    frame[3] += 1
                expect = "key" if frame[0] else "value"
                continue
            if mark == ("}" if frame[0] else "]"):
                stack.pop()
                expect = "comma_or_end" if stack else "done"
                continue
            raise ValueError(f"no comma at {m.start()}")
        # a value
        if mark == "]" and expect == "value_or_end":
            frame = stack.pop()
            yield frame[1], frame[2], "empty_array", None
            expect = "comma_or_end" if stack else "done"
            continue
        if stack:
            frame = stack[-1]
            if not frame[0]:
                path, ordinals = frame[1] + "[]", (*frame[2], str(frame[3]))
            elif frame[4]:
                path, ordinals = frame[1] + "{}", (*frame[2], frame[3])
            else:
                path, ordinals = (frame[1] + "." if frame[1] else "") + frame[3], frame[2]
        else:
            path, ordinals = "", ()
        if mark in ("{", "["):
            stack.append([mark == "{", path, ordinals, None if mark == "{" else 0, mark == "{" and path in map_paths])
            expect = "key_or_end" if mark == "{" else "value_or_end"
            continue
        if mark:
            raise ValueError(f"no value at {m.start()}")
        if which == 2:
            value = m.group(2)
            yield path, ordinals, "string", json.loads(f'"{value}"') if "\\" in value else value
        elif which == 3:
            yield path, ordinals, "number", m.group(3)
        elif m.group(4) == "null":
            yield path, ordinals, "null", None
        else:
            yield path, ordinals, "boolean", m.group(4)
        expect = "comma_or_end" if stack else "done"
        if at > size:
            return


def triples(df: DataFrame, record_id: str, text: str, map_paths: tuple[str, ...] = ()) -> DataFrame:
    """``record_id`` (as string) with ``TRIPLES`` of every record's text."""
    maps = frozenset(map_paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        names = ["record_id", "path", "ordinals", "kind", "value"]

        def batch_of(rows):
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for rid, body in zip(b.column("rid").to_pylist(), b.column("body").to_pylist()):
                if not body or not body.strip():
                    continue
                begin, checked = len(rows), False
                try:
                    for path, ordinals, kind, value in stream(body, maps):
                        rows.append((rid, path, ordinals, kind, value))
                        if len(rows) >= 50_000:
                            if not checked:  # a long record is read to its end once, so that an error leaves nothing behind
                                deque(stream(body, maps), 0)
                                checked = True
                            yield batch_of(rows)
                            rows.clear()
                            begin = 0
                except ValueError as e:
                    del rows[begin:]
                    rows.append((rid, "!error", (), "error", str(e)))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows.clear()
        yield batch_of(rows)

    return df.select(F.col(record_id).cast("string").alias("rid"), F.col(text).alias("body")).mapInArrow(run, f"record_id string, {TRIPLES}")


def ancestors(rows: DataFrame) -> DataFrame:
    """(ancestor, fields): the tables that triples fall into, by the nearest repeated ancestor of each path, with their fields."""
    ancestor = F.regexp_extract("path", r"^(.*(?:\[\]|\{\}))?", 0)
    paths = rows.where("path <> '!error'").select("path").distinct().select(ancestor.alias("ancestor"), "path")
    field = F.regexp_replace(F.substring("path", F.length("ancestor") + 1, F.length("path")), r"^\.", "")
    return paths.groupBy("ancestor").agg(F.array_sort(F.collect_set(field)).alias("fields"))


class Grouping:
    """Where each path belongs: its table, its field there, and the ordinals of its row.

    ``tables`` are (ancestor, fields); a path belongs to the deepest of them that
    repeats it.  An array level may be absent in a path (a single value), a map
    level may not.
    """

    def __init__(self, tables: list[tuple[str, list[str]]]):
        self.tables = []
        for k, (ancestor, fields) in enumerate(tables):
            levels = re.findall(r"\[\]|\{\}", ancestor)
            pattern = re.sub(r"\\\[\\\]", r"(\\[\\])?", re.escape(ancestor)) + r"(?:\.(.*))?"
            self.tables.append((len(levels), k, re.compile(pattern, re.S), levels, {f: i for i, f in enumerate(fields)}))
        self.tables.sort(key=lambda t: -t[0])
        self.known: dict[str, tuple | None] = {}

    def place(self, path: str) -> tuple[int, str, int, list[int]] | None:
        """(table, field, its column or -1, positions of the row's ordinals, -1 for an absent level)."""
        if path not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[path] = self._place(path)
        return self.known[path]

    def _place(self, path: str):
        for _, k, pattern, levels, fields in self.tables:
            m = pattern.fullmatch(path)
            if m:
                there, at, taken = list(m.groups()), [], 0
                for level in levels:
                    absent = level == "[]" and there.pop(0) is None
                    at.append(-1 if absent else taken)
                    taken += not absent
                field = there[-1] or ""
                return k, field, fields.get(field, -1), at
        return None


_ROWS = "record_id string, tbl int, ordinals array<string>, own_kind string, cells array<string>, overwritten array<struct<field: string, value: string>>"


def flat_tables(df: DataFrame, record_id: str, text: str, tables: dict[str, tuple[str, list[str]]], map_paths: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flat tables of every record's text: name to (repeated path, its fields).

    Fields are the columns wanted, as paths below the repeated path (``""`` is the
    element itself where it is a scalar).  A record in which an array is a single
    value instead gives a row at position 0.  Columns of a table: record_id,
    ordinals (the row's key), parent_ordinals, pos, own_kind (of a scalar
    element), overwritten and one string column per field (dots as underscores,
    ``value`` for ``""``).  The table ``errors`` has (record_id, error).
    """
    maps, groups = frozenset(map_paths), list(tables.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouping, width = Grouping(groups), [len(f) for _, f in groups]
        pair = pa.struct([pa.field("field", pa.string()), pa.field("value", pa.string())])
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pair)]
        names = [x.split()[0] for x in ("record_id", "tbl", "ordinals", "own_kind", "cells", "overwritten")]

        def batch_of(rows):
            cols = list(zip(*rows)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        out: list[list] = []
        for b in batches:
            for rid, body in zip(b.column("rid").to_pylist(), b.column("body").to_pylist()):
                if not body or not body.strip():
                    continue
                rows: dict[tuple, list] = {}
                try:
                    for path, ordinals, kind, value in stream(body, maps):
                        place = grouping.place(path)
                        if place is None:
                            continue
                        k, field, column, at = place
                        key = (k, *["0" if i < 0 else ordinals[i] for i in at])
                        row = rows.get(key)
                        if row is None:
                            row = rows[key] = [rid, k, key[1:], None, [None] * width[k], [], set()]
                        if field in row[6]:
                            row[5].append((field, row[4][column] if column >= 0 else None))
                        row[6].add(field)
                        if column >= 0:
                            row[4][column] = value
                        if not field:
                            row[3] = kind
                    out.extend(r[:6] for r in rows.values())
                except ValueError as e:
                    out.append([rid, -1, (), None, [str(e)], []])
                while len(out) >= 20_000:
                    yield batch_of(out[:20_000])
                    del out[:20_000]
        yield batch_of(out)

    texts = df.select(F.col(record_id).cast("string").alias("rid"), F.col(text).alias("body"))
    written = scratch.parts(texts.mapInArrow(run, _ROWS), "nested", "tbl")
    result = {"errors": written.where("tbl = -1").select("record_id", F.get("cells", F.lit(0)).alias("error"))}
    for k, (name, (ancestor, fields)) in enumerate(tables.items()):
        depth = len(re.findall(r"\[\]|\{\}", ancestor))
        cells = [F.get("cells", F.lit(i)).alias(f.replace(".", "_") or "value") for i, f in enumerate(fields)]
        own = written.where(F.col("tbl") == k)
        result[name] = own.select("record_id", "ordinals", F.slice("ordinals", 1, depth - 1).alias("parent_ordinals"), F.get("ordinals", F.lit(depth - 1)).alias("pos"), "own_kind", "overwritten", *cells)
    return result
