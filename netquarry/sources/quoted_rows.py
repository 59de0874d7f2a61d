"""Rows that fail to parse: a quote-aware finite-state tokenizer for delimited records.

The automaton runs over fixed-size chunks of raw bytes.  For each chunk it
computes the transition function of all start states at once; the functions of
a record's chunks are composed in order, which gives each chunk its true start
state; a second pass emits delimiters and the record's final state.  Records are
tokenized in lockstep over the columns of a byte matrix, so the work is numpy
over whole batches and a record of any length is never a special case.

The same composition finds record boundaries in files cut at arbitrary offsets
(``split_records``), where a chunk may begin inside a quotation.

Defined results
* null raw records are rejected with ``column_count`` (they hold no field);
* an empty record has one empty field, thus ``column_count``;
* repeated records are kept, each with its own id; extra columns pass through;
* an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry import scratch

# States of the automaton
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
# Byte classes; PAD leaves every state as it is
OTHER, COMMA, QUOTE, PAD, NEWLINE = range(5)
WIDTH = 256

# The 15 constraint commands that a record may name
COMMANDS = (
    "create_clock", "create_generated_clock", "set_input_delay", "set_output_delay", "set_false_path",
    "set_multicycle_path", "set_max_delay", "set_min_delay", "set_clock_uncertainty", "set_clock_latency",
    "set_load", "set_driving_cell", "set_max_fanout", "set_dont_touch", "set_case_analysis",
)


def _transitions(newline_ends: bool) -> np.ndarray:
    """TABLE[class, state] -> state."""
    table = np.empty((5, 5), np.uint8)
    table[OTHER] = [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN]
    table[COMMA] = [START, START, QUOTED, START, BROKEN]
    table[QUOTE] = [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN]
    table[PAD] = [START, PLAIN, QUOTED, CLOSED, BROKEN]
    table[NEWLINE] = [START, START, QUOTED, START, START] if newline_ends else table[OTHER]
    return table


_RECORD, _FILE = _transitions(False), _transitions(True)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[ord(",")], _CLASS[ord('"')], _CLASS[ord("\n")] = COMMA, QUOTE, NEWLINE


def chunk_functions(classes: np.ndarray, table: np.ndarray = _RECORD) -> np.ndarray:
    """The transition function of each row of a (chunks, width) class matrix, as (chunks, 5)."""
    state = np.tile(np.arange(5, dtype=np.uint8), (len(classes), 1))
    for column in classes.T:
        state = table[column[:, None], state]
    return state


def compose(functions: np.ndarray, owner_start: np.ndarray, initial: np.ndarray | int = START) -> np.ndarray:
    """The start state of each chunk: its owner's earlier functions applied in order to the owner's ``initial`` state.

    ``owner_start`` marks the first chunk of each owner.  Prefix doubling, so a
    record of n chunks takes log2(n) steps.
    """
    n = len(functions)
    prefix, first = functions.copy(), np.maximum.accumulate(np.where(owner_start, np.arange(n), 0))
    step = 1
    longest = int((np.arange(n) - first).max(initial=0))
    while step <= longest:
        rows = np.arange(n)
        has = rows - step >= first
        earlier, later = prefix[rows[has] - step], prefix[has]
        prefix[has] = np.take_along_axis(later, earlier.astype(np.intp), axis=1)
        step *= 2
    begin = np.broadcast_to(np.asarray(initial, np.uint8), (int(owner_start.sum()),))[np.cumsum(owner_start) - 1] if n else np.zeros(0, np.uint8)
    out = begin.copy()
    follow = np.flatnonzero(~owner_start)
    out[follow] = prefix[follow - 1, begin[follow]]
    return out


class Scan:
    """Texts as a matrix of byte classes, ``WIDTH`` columns wide, with the start state of each row."""

    def __init__(self, texts: list[bytes], table: np.ndarray, initial: np.ndarray | int = START):
        self.table, self.n = table, len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.chunks = np.maximum(1, -(-lengths // WIDTH))
        self.first = np.concatenate(([0], np.cumsum(self.chunks)[:-1])).astype(np.int64) if self.n else np.zeros(0, np.int64)
        total = int(self.chunks.sum())
        classes = np.full(total * WIDTH, PAD, np.uint8)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        where = np.repeat(self.first * WIDTH - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
        classes[where.astype(np.int64)] = _CLASS[flat]
        self.classes = classes.reshape(total, WIDTH)
        starts = np.zeros(total, bool)
        starts[self.first] = True
        self.start = compose(chunk_functions(self.classes, table), starts, initial)
        self.owner = np.repeat(np.arange(self.n), self.chunks)

    def offsets(self, marks: np.ndarray) -> list[np.ndarray]:
        """The marked places of each text, as offsets in it."""
        rows, cols = np.nonzero(marks)
        owner = self.owner[rows]
        offset = (rows - self.first[owner]) * WIDTH + cols
        return np.split(offset, np.searchsorted(owner, np.arange(1, self.n))) if self.n else []

    def columns(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(column, its classes, states before it, states after it), left to right."""
        state = self.start
        for j in range(WIDTH):
            column = self.classes[:, j]
            after = self.table[column, state]
            yield j, column, state, after
            state = after


def tokenize(records: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Offsets of each record's delimiters, its final state, and where its quoting broke (-1 if it did not).

    Quoting breaks at the first byte that may not stand where it does, or at the
    opening quote that is never closed.
    """
    scan = Scan(records, _RECORD)
    marks, breaks, opens = (np.zeros(scan.classes.shape, bool) for _ in range(3))
    final = scan.start
    for j, column, state, after in scan.columns():
        marks[:, j] = (column == COMMA) & (state != QUOTED) & (state != BROKEN)
        breaks[:, j] = (after == BROKEN) & (state != BROKEN)
        opens[:, j] = (after == QUOTED) & (state == START)
        final = after
    if not len(records):
        return [], final, np.zeros(0, np.int64)
    final = final[scan.first + scan.chunks - 1]
    wrong = np.full(len(records), -1, np.int64)
    for state, places, pick in ((BROKEN, breaks, 0), (QUOTED, opens, -1)):
        for k in np.flatnonzero(final == state):
            rows, cols = np.nonzero(places[scan.first[k] : scan.first[k] + scan.chunks[k]])
            wrong[k] = rows[pick] * WIDTH + cols[pick]
    return scan.offsets(marks), final, wrong


def unquote(field: bytes) -> str:
    """A field's value: its enclosing quotes off, its doubled quotes single."""
    if field[:1] == b'"':
        field = field[1:-1].replace(b'""', b'"')
    return field.decode("utf-8", "replace")


def balanced(text: str) -> bool:
    """Whether square brackets and braces nest properly."""
    stack = []
    for c in text:
        if c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and (not stack or stack.pop() != c):
            return False
    return not stack


_FIELD_OF = {"bad_command": 1, "bad_raw_line": 2, "bad_line_number": 3}


def judge(fields: list[str] | None, broken: bool) -> str | None:
    """The first reason that holds for a constraint record, null for a valid one."""
    if broken:
        return "quoting"
    if fields is None or len(fields) != 5:
        return "column_count"
    _, command, raw_line, line, _ = fields
    if command not in COMMANDS:
        return "bad_command"
    if not (line.isascii() and line.isdigit()) or not line.strip("0"):
        return "bad_line_number"
    words = raw_line.split(None, 1)
    if not words or words[0] != command or not balanced(raw_line):
        return "bad_raw_line"
    return None


def parse_constraint_rows(df: DataFrame, raw: str = "raw_row") -> DataFrame:
    """Each row of ``df`` with its typed fields or the reason why it is rejected.

    Adds ``reason`` (null for a valid row), ``error_at`` (byte offset at which the
    quoting broke, or else at which the field begins that is rejected, 0 for a wrong
    number of fields), ``constraint_id``, ``constraint_type``,
    ``raw_line``, ``line_number bigint`` and ``file_path``; columns of ``df`` with
    those names are replaced.  A line number beyond a bigint is a
    ``bad_line_number``.
    """
    added = T._parse_datatype_string("reason string, error_at int, constraint_id string, constraint_type string, raw_line string, line_number bigint, file_path string")
    names = [f.name for f in added.fields]
    kept = df.select(*[c for c in df.columns if c not in names or c == raw])
    inside = kept.withColumnRenamed(raw, "__raw__") if raw in names else kept
    source = "__raw__" if raw in names else raw
    schema = T.StructType([*inside.schema.fields, *added.fields])
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(source).to_pylist()
            records = [(t or "").encode() for t in texts]
            marks, final, wrong = tokenize(records)
            out = []
            for text, record, at, state, place in zip(texts, records, marks, final.tolist(), wrong.tolist()):
                broken = state in (QUOTED, BROKEN)
                fields = None
                if not broken and text is not None:
                    cut = [-1, *at.tolist(), len(record)]
                    fields = [unquote(record[a + 1 : b]) for a, b in zip(cut, cut[1:])]
                reason = judge(fields, broken)
                number = None
                if reason is None:
                    digits = fields[3].lstrip("0")
                    number = int(digits) if len(digits) < 20 else 1 << 63
                    if number >= 1 << 63:
                        reason, number = "bad_line_number", None
                if reason is None:
                    out.append((None, None, fields[0], fields[1], fields[2], number, fields[4]))
                else:
                    field = _FIELD_OF.get(reason)
                    out.append((reason, int(at[field - 1]) + 1 if field else max(0, place), None, None, None, None, None))
            cols = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*batch.schema.names, *names])

    out = inside.mapInArrow(run, schema)
    return out.withColumnRenamed("__raw__", raw) if raw in names and raw not in added.names else out


def _scan(df: DataFrame, combine) -> DataFrame:
    """Inclusive prefix combination of ``v`` along the chunks of each file, by doubling.

    ``df(file, chunk_no, v)`` with chunk_no dense from 0.  log2(chunks) joins, so no
    task holds a file.
    """
    top = df.agg(F.max("chunk_no")).first()[0] or 0
    at, step = df, 1
    while step <= top:
        before = at.select("file", (F.col("chunk_no") + step).alias("chunk_no"), F.col("v").alias("u"))
        at = scratch.table(at.join(before, ["file", "chunk_no"], "left").select("file", "chunk_no", F.when(F.col("u").isNull(), F.col("v")).otherwise(combine(F.col("u"), F.col("v"))).alias("v")), "scan")
        step *= 2
    return at


def split_records(chunks: DataFrame) -> DataFrame:
    """Records of files given as chunks cut anywhere, quoted line breaks kept.

    ``chunks(file, chunk_no, text)``, chunk_no dense from 0.  One pass computes
    every chunk's transition function, a doubling scan composes them, a second
    pass cuts each chunk at its record ends.  Pieces of a record that spans chunks
    are joined by the (chunk, piece) where it began.  Output: ``file, chunk_no,
    piece_no, record`` in which chunk_no and piece_no are those of its beginning;
    empty records are left out, null texts count as empty, a carriage return
    before a record's end is not part of it; a record whose quoting breaks ends
    with its line.
    """

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                data = _CLASS[np.frombuffer((text or "").encode(), np.uint8)]
                padded = np.full(max(1, -(-len(data) // WIDTH)) * WIDTH, PAD, np.uint8)
                padded[: len(data)] = data
                f = np.arange(5)
                for row in chunk_functions(padded.reshape(-1, WIDTH), _FILE):
                    f = row[f]
                rows.append(f.tolist())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("chunk_no"), pa.array(rows, pa.list_(pa.int32()))], names=["file", "chunk_no", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            data_of = [(t or "").encode() for t in b.column("text").to_pylist()]
            scan = Scan(data_of, _FILE, np.array(b.column("start").to_pylist(), np.uint8))
            ends = np.zeros(scan.classes.shape, bool)
            for j, column, state, _ in scan.columns():
                ends[:, j] = (column == NEWLINE) & (state != QUOTED)
            for file, no, data, at in zip(b.column("file").to_pylist(), b.column("chunk_no").to_pylist(), data_of, scan.offsets(ends)):
                begin, piece = 0, 0
                for end in at.tolist():
                    rows.append((file, no, piece, data[begin:end].decode("utf-8", "replace"), True))
                    begin, piece = end + 1, piece + 1
                rows.append((file, no, piece, data[begin:].decode("utf-8", "replace"), False))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "chunk_no", "piece_no", "piece", "ended"])

    chunks = chunks.select("file", F.col("chunk_no").cast("int").alias("chunk_no"), "text")
    composed = _scan(chunks.mapInArrow(functions, "file string, chunk_no int, v array<int>"), lambda u, v: F.transform(u, lambda s: F.get(v, s)))
    start = composed.select("file", (F.col("chunk_no") + 1).alias("chunk_no"), F.get("v", F.lit(START)).alias("start"))
    pieces = scratch.table(chunks.join(start, ["file", "chunk_no"], "left").withColumn("start", F.coalesce("start", F.lit(START))).mapInArrow(cut, "file string, chunk_no int, piece_no int, piece string, ended boolean"), "pieces")
    # where the record began that is open at the end of each chunk
    opened = pieces.groupBy("file", "chunk_no").agg(F.max("piece_no").alias("last"))
    opened = opened.select("file", "chunk_no", F.when(F.col("last") > 0, F.struct("chunk_no", F.col("last").alias("piece_no"))).when(F.col("chunk_no") == 0, F.struct(F.lit(0).alias("chunk_no"), F.lit(0).alias("piece_no"))).alias("v"))
    opened = _scan(opened, lambda u, v: F.coalesce(v, u)).select("file", (F.col("chunk_no") + 1).alias("chunk_no"), F.lit(0).alias("piece_no"), "v")
    keyed = pieces.join(opened, ["file", "chunk_no", "piece_no"], "left")
    key = F.coalesce("v", F.struct("chunk_no", "piece_no"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "piece_no", "piece"))), lambda x: x["piece"])
    out = keyed.groupBy("file", key.alias("key")).agg(F.array_join(parts, "").alias("record"))
    return out.select("file", "key.chunk_no", "key.piece_no", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
