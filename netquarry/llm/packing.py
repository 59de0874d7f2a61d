"""Filling containers of fixed capacity: mixture-controlled packing.

Texts are counted in tokens of a public tokenizer, dealt to partitions by a hash
of their id, and packed there by deficit round-robin over one queue per source.
Every container (window) gives each source a quantum of its target share; the
source with the largest deficit counter is served.  A container begins with the
oldest text of that source, so that no text waits for ever; the rest of it is
filled with the oldest texts that fit, out of the next ``LOOK`` of each source, and
its last gap with the largest of these.  Queues are in the order of a hash of the
id, so that neither size nor age gathers anywhere.  What a text takes beyond its
source's counter is paid back in the windows that follow.  Counters go on from
window to window, and from partition to partition: since a partition packs all of
its texts, the counters it starts with are prefix sums over the partitions before
it.

A text larger than the capacity is cut into pieces; those that fill a container are
items of their source like others, charged to its counter; its rest is packed like a
text.

Defined results
* null texts give no row; empty texts have size 0 and still get a container;
* a null source is a queue of its own; equal texts are packed each;
* without given shares the target is each source's share of all tokens; a source
  that the given shares leave out has share 0 and is served when others are empty
  or nothing else fits;
* an empty table gives none.  The result depends on the texts and parameters only.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level vocabularies of this kind split a text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PER_PARTITION = 50_000
LOOK = 96  # texts of a source that a container may choose from
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file that was sent with the job or is at its own path, once per process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(vocabulary))
        with open(sent if os.path.exists(sent) else vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every text that is not null; the vocabulary is a file of the driver's."""
    docs.sparkSession.sparkContext.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


class Queue:
    """Items (doc, piece, size) of one source in their order, of which the next ``look`` are in sight."""

    def __init__(self, items: list[tuple[int, int, int]], look: int):
        self.later = iter(items)
        self.ahead: list[tuple[int, int, int]] = []
        self.look = look
        self._fill()

    def _fill(self) -> None:
        while len(self.ahead) < self.look and (item := next(self.later, None)) is not None:
            self.ahead.append(item)

    def oldest(self, room: int) -> int:
        """The place of the oldest item in sight that fits, -1 for none."""
        return next((k for k, x in enumerate(self.ahead) if x[2] <= room), -1)

    def largest(self, room: int) -> int:
        """The place of the largest item in sight that fits, the oldest of equal ones, -1 for none."""
        best, size = -1, -1
        for k, x in enumerate(self.ahead):
            if size < x[2] <= room:
                best, size = k, x[2]
        return best

    def take(self, place: int) -> tuple[int, int, int]:
        """The item at a place."""
        item = self.ahead.pop(place)
        self._fill()
        return item


def pack(items: list[tuple[int, int, int, str]], shares: dict[str, float], counters: dict[str, float], capacity: int = CAPACITY, look: int = LOOK) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, piece, size, container, offset) of items (doc, piece, size, source) by deficit round-robin.

    An item of size 0 takes the room of 1, so that a container holds a bounded number.
    """
    queues = {s: Queue([x[:3] for x in items if x[3] == s], look) for s in sorted({x[3] for x in items})}
    deficit = {s: counters.get(s, 0.0) for s in queues}
    container = 0
    while queues:
        for s in deficit:
            deficit[s] += shares.get(s, 0.0) * capacity
        room, first = capacity, True
        while True:
            lagging = sorted(queues, key=lambda s: (-deficit[s], s))
            if first:
                s, place = lagging[0], 0
            else:
                # the last gap is closed by what leaves least of it
                pick = Queue.largest if room * 4 <= capacity else Queue.oldest
                s, place = next(((s, k) for s in lagging if (k := pick(queues[s], max(room, 0))) >= 0), (None, -1))
                if s is None:
                    break
            doc, piece, size = queues[s].take(place)
            yield doc, piece, size, container, capacity - room
            room -= max(1, size)
            deficit[s] -= size
            first = False
            if not queues[s].ahead:
                del queues[s]
            if room <= 0:
                break
        container += 1


def pack_texts(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, shares: dict[str, float] | None = None, per_partition: int = PER_PARTITION, look: int = LOOK) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id, container_offset) for ``docs(doc_id, text, source)``."""
    sized = scratch.table(sizes(docs, vocabulary), "sizes")
    total, n = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-n // per_partition))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # what each partition holds of each source, and the counters that it starts with
    held = sized.groupBy("part", "source").agg(F.sum("n_tokens").alias("held"))
    of_source = held.groupBy("source").agg(F.sum("held").alias("of_source"))
    if shares is None:
        share = of_source.select("source", (F.col("of_source") / F.lit(max(1, total))).alias("share"))
    else:
        given = [(k, float(v) / (sum(shares.values()) or 1.0)) for k, v in shares.items()]
        share = of_source.select("source").join(sized.sparkSession.createDataFrame(given or [("", 0.0)], "source string, share double"), "source", "left").fillna(0.0, ["share"])
    # one row for each partition, in order
    of_part = held.groupBy("part").agg(F.sum("held").alias("of_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select("part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("tokens_before"))
    of_same = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.withColumn("held_before", F.coalesce(F.sum("held").over(of_same), F.lit(0))).join(of_part, "part").join(share, "source")
    carried = carried.withColumn("counter", F.col("share") * F.col("tokens_before") - F.col("held_before"))
    table = sized.join(carried.select("part", "source", "share", "counter"), ["part", "source"])

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        shares_here, counters, items, out = {}, {}, [], []
        rows = zip(*(group.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "share", "counter")))
        # a hash of the id is an order without trends; the id settles what the hash does not
        rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0] is None, r[0] or 0, r[1:]))
        for doc, source, size, share_here, counter in rows:
            shares_here[source], counters[source] = share_here, counter
            whole, rest = divmod(size, capacity)
            items.extend((doc, piece, capacity, source) for piece in range(whole))
            if rest or not whole:
                items.append((doc, whole, rest, source))
        for doc, piece, size, container, offset in pack(items, shares_here, counters, capacity, look):
            out.append((doc, piece, piece * capacity, size, (part << 32) | container, offset))
        names = ["doc_id", "piece_no", "start_token", "n_tokens", "container_id", "container_offset"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)

    schema = "doc_id bigint, piece_no int, start_token bigint, n_tokens int, container_id bigint, container_offset int"
    return table.groupBy("part").applyInArrow(run, schema)


def deviations(packed: DataFrame, docs: DataFrame, thirds: int = 3) -> DataFrame:
    """(third, containers, filled, deviation) of each third of every partition's run of containers.

    ``filled`` is the mean fill against the fullest container, ``deviation`` the
    mean, over containers and sources, of how far a source's share of a container's
    tokens is from its share of all.
    """
    sources = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    rows = packed.join(sources, "doc_id").select("container_id", F.shiftright("container_id", 32).alias("part"), "source", "n_tokens")
    number = F.col("container_id").bitwiseAND((1 << 32) - 1)
    held = scratch.table(rows.groupBy("part", "container_id", "source").agg(F.sum("n_tokens").alias("n")), "held")
    total, n_sources, fullest = *held.agg(F.sum("n"), F.count_distinct("source")).first(), held.groupBy("container_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    target = held.groupBy("source").agg((F.sum("n") / F.lit(max(1, total or 0))).alias("target"))
    last = held.groupBy("part").agg(F.max(number).alias("last"))
    whole = held.groupBy("part", "container_id").agg(F.sum("n").alias("whole")).where("whole > 0")
    third = F.least(F.lit(thirds - 1), F.floor(number * thirds / (F.col("last") + 1))).cast("int")
    # sources that a container lacks are off by their whole target, and all targets add up to 1
    off = held.join(whole, ["part", "container_id"]).join(target, "source").groupBy("part", "container_id", "whole").agg((F.sum(F.abs(F.col("n") / F.col("whole") - F.col("target")) - F.col("target")) + 1).alias("off"))
    per = off.join(last, "part").select(third.alias("third"), "whole", "off")
    return per.groupBy("third").agg(F.count("*").alias("containers"), (F.avg("whole") / F.lit(max(1, fullest or 0))).alias("filled"), (F.avg("off") / F.lit(max(1, n_sources))).alias("deviation"))
