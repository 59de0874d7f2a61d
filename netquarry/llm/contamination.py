"""Evaluation texts leaking into training texts: size-partitioned MinHash containment.

Texts are normalised to words that ignore case, punctuation, markup, invisible and
look-alike characters and the notation of numbers and identifiers.  An item's
runs of ``RUN`` words are queries; the documents' windows of shingles (word
pairs) are the searched sets, partitioned by size.  For each partition the
containment threshold becomes a Jaccard threshold, which gives the number of hash
functions that find a contained run with probability ``RECALL``.  A window that
shares a minimum with a run of an item is a candidate; it is verified by the
exact containment of shingles, and then by exact edit distances of words: at least
``RUN`` words of the item in a row, at most one edit per five of them.

Word pairs are used, not five words, since one word in five may differ.

Documents are read and hashed once, however many items there are.  The items'
minima are a table; up to ``IN_TASK`` of them (counted first) every task gets them
and verifies its candidates at once.  Beyond that, tasks get a filter of fixed size
only; windows that pass it are joined with the table of minima, and verified after
the join.

Defined results
* null and empty documents and items, documents with a null id, and items of fewer
  than ``RUN`` words, give no row; repeated documents each give theirs; an item
  counts once per document;
* texts of any length are read whole, in windows that overlap;
* extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch

RUN = 12
EDITS_PER = 5
HALF = 16  # a window is two neighbouring half windows of so many shingles
RECALL = 0.999
IN_TASK = 4_000_000  # minima of items that a task may hold
FILTER_BITS = 28  # size of the filter beyond that, as a power of two
SIZES = (8, 16, 2 * HALF)  # upper bounds of the partitions of windows by size
SEGMENT = 1024 * HALF  # shingles taken at once, which bounds memory for texts of any length

# Letters that look like Latin ones
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ӏ": "l", "ј": "j",
    "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "υ": "u", "ѵ": "v", "ѡ": "w", "ԝ": "w",
    "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x",
    "γ": "y", "ζ": "z", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_GROUPED = re.compile(r"(?<![\d.,])(\d{1,3})(?:[   '’ ](\d{3}))+(?!\d)")
_DROP = re.compile(r"[^\w\s]+|_+")
_ASCII_DROP = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())}
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]+")
_MARKS = re.compile(r"[̀-ͯ]+")


def words(text: str) -> list[str]:
    """The words of a text in normal form."""
    s = text
    plain = s.isascii()
    if not plain:
        s = _INVISIBLE.sub("", s)
    if "&" in s:
        s = html.unescape(s)
        plain = s.isascii()
    if "<" in s:
        s = _TAG.sub("", s)
    if plain:
        s = s.lower()
        if _GROUPED.search(s):
            s = _GROUPED.sub(lambda m: re.sub(r"\D", "", m.group()), s)
        return s.translate(_ASCII_DROP).split()
    s = unicodedata.normalize("NFKD", s.casefold())
    s = _MARKS.sub("", s).translate(_FOLD)
    s = _GROUPED.sub(lambda m: re.sub(r"\D", "", m.group()), s)
    return _DROP.sub("", s).split()


LEAST = RUN - 1 - 2 * (RUN // EDITS_PER)  # shingles that a run with the most edits keeps
REACH = RUN - 1 + RUN // EDITS_PER  # shingles over which a run with the most words added extends


def slots_for(size: int) -> int:
    """Hash functions that a set of ``size`` shingles needs so that a contained run is found with probability ``RECALL``."""
    jaccard = LEAST / max(RUN - 1, RUN - 1 + size - LEAST)
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-9, 1 - jaccard))))


SLOTS = slots_for(SIZES[-1])
_RNG = np.random.Generator(np.random.PCG64(20240607))
_MUL = _RNG.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SLOTS, dtype=np.uint64)
# the slot is mixed into a minimum, so that one table holds all slots
_SLOT = np.arange(SLOTS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


class Hasher(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def shingles(self, ws: list[str]) -> np.ndarray:
        """Hashes of the pairs of neighbouring words."""
        h = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))


def permuted(shingles: np.ndarray, slots: int) -> np.ndarray:
    """(slots, n) permuted hash values."""
    x = shingles[None, :] * _MUL[:slots, None]
    x += _ADD[:slots, None]
    x ^= x >> np.uint64(31)
    return x


def run_minima(ws: list[str], hasher: Hasher) -> np.ndarray:
    """The distinct minima, over all hash functions, of an item's runs."""
    runs = np.lib.stride_tricks.sliding_window_view(permuted(hasher.shingles(ws), SLOTS), RUN - 1, axis=1).min(axis=2)
    return np.unique(runs ^ _SLOT[:, None])


def window_minima(shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first shingles of windows, their minima as (hash functions, windows)), partition by partition of their sizes.

    All windows but a text's last two have the largest size.
    """
    n = len(shingles)
    for base in range(0, n, SEGMENT):  # a segment's last window ends with the next one's first half
        part = shingles[base : base + SEGMENT + HALF]
        begins = np.arange(0, max(1, len(part) - HALF if base + SEGMENT < n or len(part) > HALF else 1), HALF)
        sizes = np.minimum(len(part) - begins, 2 * HALF)
        p = halves = None
        for low, high in zip((0, *SIZES), SIZES):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(mine):
                if p is None:
                    p = permuted(part, slots_for(int(sizes.max())))
                    halves = np.minimum.reduceat(p, np.arange(0, p.shape[1], HALF), axis=1)
                slots = min(slots_for(high), len(p))
                after = np.minimum(mine + 1, halves.shape[1] - 1)
                yield base + begins[mine], np.minimum(halves[:slots, mine], halves[:slots, after]) ^ _SLOT[:slots, None]


class Index:
    """Minima of the runs of items, and their texts."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        hasher = Hasher()
        self.texts = items
        shingles = [hasher.shingles(ws) for _, ws in items]
        self.sets = [frozenset(sh.tolist()) for sh in shingles]
        self.known = np.unique(np.concatenate(shingles)) if items else np.zeros(0, np.uint64)
        minima = [run_minima(ws, hasher) for _, ws in items]
        value = np.concatenate(minima) if items else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(m) for m in minima])
        order = np.argsort(value, kind="stable")
        self.owners = owner[order]
        self.values, self.first = np.unique(value[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def near(self, shingles: np.ndarray) -> np.ndarray:
        """For each shingle of a text how many before it begin a stretch as dense in items' shingles as a run is."""
        at = np.searchsorted(self.known, shingles)
        at[at == len(self.known)] = 0
        held = np.concatenate(([0], np.cumsum(self.known[at] == shingles)))
        dense = held[np.minimum(np.arange(len(shingles)) + REACH, len(shingles))] - held[:-1] >= LEAST
        return np.concatenate(([0], np.cumsum(dense)))

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first shingle of a window, number of an item's text) that share a minimum; not where no run of any item could be."""
        if not len(self.values) or len(shingles) < LEAST:
            return
        dense = None
        for begins, minima in window_minima(shingles):
            at = np.searchsorted(self.values, minima)
            at[at == len(self.values)] = 0
            hit = self.values[at] == minima
            some = np.flatnonzero(hit.any(axis=0))
            if not len(some):
                continue
            if dense is None:
                dense = self.near(shingles)
            lo, hi = np.maximum(0, begins[some] - HALF), np.minimum(len(shingles), begins[some] + 3 * HALF)
            for w in some[dense[hi] > dense[lo]]:
                mine = np.unique(at[hit[:, w], w])
                for k in np.unique(np.concatenate([self.owners[self.first[v] : self.last[v]] for v in mine])).tolist():
                    yield int(begins[w]), k


def longest_run(item: list[str], doc: list[str]) -> int:
    """The most words of ``item`` in a row, first and last of them matched, that ``doc`` holds with at most one edit per ``EDITS_PER``; 0 if fewer than ``RUN``.

    Edit distances of the item's runs of equal length, from every start at once:
    a row of the table is one word longer than the one before it.
    """
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item])
    b = np.array([ids.setdefault(w, len(ids)) for w in doc])
    m, far, best = len(a), 1 << 20, 0
    if m < RUN or not len(b):
        return 0
    equal = a[:, None] == b[None, :]
    at = np.arange(len(b) + 1)
    edits = np.full((m, len(b) + 1), far, np.int32)
    edits[:, 1:][equal] = 0
    for length in range(2, m + 1):
        old, same = edits[: m - length + 1], equal[length - 1 :]
        if length >= RUN and (np.where(same, old[:, :-1], far) * EDITS_PER <= length).any():
            best = length
        edits = old + 1
        np.minimum(edits[:, 1:], old[:, :-1] + ~same, out=edits[:, 1:])
        edits = np.minimum.accumulate(edits - at, axis=1) + at  # words added in the text
    return best


def dense(shingles: list[int], item: frozenset[int]) -> bool:
    """Exact containment: whether so many shingles of an item stand as close together as in a run of it."""
    at = [i for i, v in enumerate(shingles) if v in item]
    return len(at) >= LEAST and any(b - a < REACH for a, b in zip(at, at[LEAST - 1 :]))


def margin(start: int, n: int) -> tuple[int, int]:
    """The words around a window, in which a run that it holds lies wholly."""
    return max(0, start - HALF), min(n, start + 3 * HALF + 1)


def leaks(text: str, index: Index, hasher: Hasher) -> set[int]:
    """The items of which a text holds a passage."""
    ws = words(text)
    if len(ws) < RUN - RUN // EDITS_PER:
        return set()
    shingles = hasher.shingles(ws)
    found: set[int] = set()
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, k in sorted(index.candidates(shingles)):
        lo, hi = margin(start, len(ws))
        if dense(shingles[lo : hi - 1].tolist(), index.sets[k]):
            if spans[k] and lo <= spans[k][-1][1]:
                spans[k][-1] = (spans[k][-1][0], hi)
            else:
                spans[k].append((lo, hi))
    for k, where in spans.items():
        item, iw = index.texts[k]
        if item not in found and any(longest_run(iw, ws[lo:hi]) >= RUN for lo, hi in where):
            found.add(item)
    return found


def _item_texts(items: DataFrame) -> DataFrame:
    """(item_id, words, minima) of the items' texts that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text)
                if len(ws) >= RUN:
                    rows.append((item, " ".join(ws), run_minima(ws, hasher).view(np.int64).tolist()))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["item_id", "words", "minima"])

    listed = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    return scratch.table(listed.mapInArrow(run, "item_id bigint, words string, minima array<bigint>"), "items")


def find_leaks(docs: DataFrame, items: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(doc_id, item_id) for ``docs(doc_id bigint, text)`` and ``items(item_id bigint, text)``; an item may have several texts."""
    texts = _item_texts(items)
    total = texts.agg(F.sum(F.size("minima"))).first()[0] or 0
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if total > in_task:
        return _joined(docs, texts)
    rows = sorted((r[0], r[1].split(" ")) for r in texts.select("item_id", "words").collect())  # their size was just checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = Index(rows), Hasher()
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hit = sorted(leaks(text, index, hasher))
                ids.extend([doc] * len(hit))
                found.extend(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def _filter(minima: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2**``bits`` remainders that some minimum has; what is collected is bounded by that number alone."""
    place = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 6)
    rows = minima.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(v & {63} as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _joined(docs: DataFrame, texts: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The same rows for many items: windows that pass a filter are joined with the table of minima."""
    keyed = scratch.table(texts.select("item_id", "words", F.xxhash64("item_id", "words").alias("key"), "minima"), "keyed")
    minima = scratch.table(keyed.select(F.explode("minima").alias("v"), "item_id", "key").distinct(), "minima")
    passes = docs.sparkSession.sparkContext.broadcast(_filter(minima, bits))
    mask = np.uint64((1 << bits) - 1)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hasher = passes.value, Hasher()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text)
                if len(ws) < RUN - RUN // EDITS_PER:
                    continue
                for begins, found in window_minima(hasher.shingles(ws)):
                    place = found & mask
                    hit = (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
                    for w in np.flatnonzero(hit.any(axis=0)):
                        lo, hi = margin(int(begins[w]), len(ws))
                        rows.append((doc, int(begins[w]), np.unique(found[hit[:, w], w]).view(np.int64).tolist(), " ".join(ws[lo:hi])))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "vs", "near"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, found = [], []
            for doc, item, near, ws in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "near", "words"))):
                here, item_words = near.split(" "), ws.split(" ")
                if dense(hasher.shingles(here).tolist(), frozenset(hasher.shingles(item_words).tolist())) and longest_run(item_words, here) >= RUN:
                    ids.append(doc)
                    found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    windows = scratch.table(docs.mapInArrow(hits, "doc_id bigint, start bigint, vs array<bigint>, near string"), "windows")
    pairs = windows.select("doc_id", "start", F.explode("vs").alias("v")).join(minima, "v").select("doc_id", "start", "item_id", "key").distinct()
    seen = pairs.join(windows.select("doc_id", "start", "near"), ["doc_id", "start"]).join(keyed.select("item_id", "key", "words"), ["item_id", "key"])
    return seen.select("doc_id", "item_id", "near", "words").mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()
