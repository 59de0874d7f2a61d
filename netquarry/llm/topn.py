"""Top N items within every group, also where a group holds millions of items.

Method: simultaneous per-group bisection.  Each row has an order-preserving code,
the words (-score, tie number, pieces of the identifier).  All groups refine
their cutoff at once: a pass splits each group's open interval by equally spaced
midpoints, counts the rows between them with one pre-aggregated count, and keeps
open only the section in which the N-th row must lie.  Rows above it are taken,
rows below it are dropped, so every pass reads a fraction of the one before.  A
group is finished when the rows taken and the section add up to exactly N.  A
section of equal words moves to the next word.  ``SECTIONS`` - 1 midpoints are
counted per pass (2 would be plain bisection, with more jobs); a group never has
more counts than rows.

No group meets in one task: counting is by (group, section) after map-side
combination, only sections (at most ``SECTIONS`` rows a group) are ordered by a
window, and the final ranks are over N rows a group.  A group's cutoff is looked up
by its rows through ``join_one``, which splits a group of more rows than one task
may take.  A pass writes its rows by their fate, so that the next one reads only
what is open, and drops the table of the pass before.

Defined results
* rows with null or NaN score, null group or null identifier do not count;
  infinite scores count and order as usual;
* an identifier counts once per group, with its highest score and, among rows of
  that score, the lowest tie number (a null tie number comes last);
* order: score descending, tie number ascending, identifier ascending by code
  points; equal keys cannot occur, so ranks are unique and repeatable;
* groups with fewer than N identifiers give what they have; an empty table none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.operators.skew import HOT, join_one

SECTIONS = 256
_PIECE = 6  # bytes of the identifier in a word: exact in a double


def _section(word: Column, lo: Column, hi: Column) -> Column:
    """The section 0..SECTIONS-1 of a word within [lo, hi], monotonic, ends apart."""
    span = hi / 2 - lo / 2
    inner = F.floor((word / 2 - lo / 2) / span * SECTIONS)
    odd = (span == 0) | F.isnan(span) | (F.abs(span) == float("inf"))
    split = F.when(word == lo, 0).when(word == hi, SECTIONS - 1).otherwise(SECTIONS // 2)
    return F.when(odd, split).otherwise(F.least(F.lit(SECTIONS - 1), F.greatest(F.lit(0), inner))).cast("int")


def _pieces(identifier: Column, level: Column) -> Column:
    """Word number ``level`` of an identifier: six bytes of its UTF-8, zero past its end."""
    part = F.rpad(F.hex(F.substring(F.encode(identifier, "UTF-8"), level * _PIECE + 1, _PIECE)), 2 * _PIECE, "0")
    return F.conv(part, 16, 10).cast("double")


def _common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading bytes of two different strings."""
    byte = lambda s, i: F.hex(F.substring(F.encode(s, "UTF-8"), i, F.lit(1)))
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(a), F.octet_length(b), F.lit(1))), lambda i: byte(a, i) == byte(b, i))
    return F.array_position(same, False) - 1


TAKEN, OPEN, TIED = 1, 0, 2
_KEYS = ["grp", "identifier", "minus", "tie"]


def _cut(active: DataFrame, word: Column, n_rows: int, hot: int) -> DataFrame:
    """One pass over the open rows: their fate, and the next interval of those that stay open.

    Rows below the cutoff are left out; rows of a section of equal words are tied.
    """
    rows = active.withColumn("word", word)
    rows = rows.withColumn("section", _section(F.col("word"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    counts = rows.groupBy("grp", "section").agg(F.count("*").alias("n"), F.min("word").alias("lo"), F.max("word").alias("hi"), F.first("need").alias("need"))
    w = Window.partitionBy("grp").orderBy("section")
    before = (F.sum("n").over(w) - F.col("n")).alias("before")
    at = counts.select("grp", "section", "n", "lo", "hi", "need", before).where("before < need and before + n >= need")
    at = at.select("grp", F.col("section").alias("cut"), (F.col("need") - F.col("before")).alias("left"), F.col("n").alias("held"), "lo", "hi")
    inside = F.when(F.col("held") == F.col("left"), TAKEN).when(F.col("lo") == F.col("hi"), TIED).otherwise(OPEN)
    fate = F.when(F.col("section") < F.col("cut"), TAKEN).when(F.col("section") == F.col("cut"), inside)
    level = ["level"] if "level" in active.columns else []
    out = join_one(rows.drop("need"), at, "grp", n_rows, ["identifier"], hot).withColumn("fate", fate).where("fate is not null")
    return out.select(*_KEYS, *level, F.col("left").alias("need"), "lo", "hi", "fate")


def top_n(df: DataFrame, group: Column, identifier: Column, score: Column, tie: Column, n: int, hot: int = HOT) -> DataFrame:
    """(group_key, rank_no, identifier, score, tie) of the N best items of each group; groups of more than ``hot`` rows are split."""
    rows = df.select(group.alias("grp"), identifier.alias("identifier"), (-score.cast("double") + F.lit(0.0)).alias("minus"), F.coalesce(tie.cast("double"), F.lit(float("inf"))).alias("tie"))
    rows = rows.where("grp is not null and identifier is not null and minus is not null and not isnan(minus)")
    best = rows.groupBy("grp", "identifier").agg(F.min(F.struct("minus", "tie")).alias("best"))
    best = scratch.table(best.select("grp", "identifier", "best.minus", "best.tie"), "best")
    sizes = scratch.table(best.groupBy("grp").agg(F.count("*").alias("held"), F.min("minus").alias("lo"), F.max("minus").alias("hi")), "sizes")
    count = sizes.agg(F.sum("held")).first()[0] or 0
    # groups of at most N are taken as they are, groups of one score are tied from the start
    fate = F.when(F.col("held") <= n, TAKEN).when(F.col("lo") == F.col("hi"), TIED).otherwise(OPEN)
    begun = join_one(best, sizes, "grp", count, ["identifier"], hot).withColumn("fate", fate).withColumn("need", F.lit(n).cast("long"))
    first = scratch.parts(begun.select(*_KEYS, "need", "lo", "hi", "fate"), "pass", "fate")
    scratch.drop(best, sizes)
    passes, stage, ties = [first], 0, [first]

    def left(table: DataFrame) -> dict[int, int]:
        return {r[0]: r[1] for r in table.groupBy("fate").count().collect()}

    held = left(first)
    word, active, n_open, n_tied = F.col("minus"), first.where(F.col("fate") == OPEN).drop("fate"), held.get(OPEN, 0), held.get(TIED, 0)
    while True:
        # bisect on one word until each open section holds equal words or is finished
        while n_open:
            passed = scratch.parts(_cut(active, word, n_open, hot), "pass", "fate")
            passes.append(passed)
            ties.append(passed)
            held = left(passed)
            active, n_open, n_tied = passed.where(F.col("fate") == OPEN).drop("fate"), held.get(OPEN, 0), n_tied + held.get(TIED, 0)
        if not n_tied:
            break
        stage += 1
        tied = reduce(DataFrame.unionByName, [t.where(F.col("fate") == TIED).select(*_KEYS, "need") for t in ties])
        ties = []
        if stage == 1:
            word = F.col("tie")
            ends = tied.groupBy("grp").agg(F.min(word).alias("lo"), F.max(word).alias("hi"))
            same = TIED
        else:
            # the identifiers' first differing piece, common prefixes skipped at once
            ends = tied.groupBy("grp").agg(F.min("identifier").alias("a"), F.max("identifier").alias("b"))
            ends = ends.select("grp", F.floor(_common_prefix(F.col("a"), F.col("b")) / _PIECE).cast("int").alias("level"), "a", "b")
            word = _pieces(F.col("identifier"), F.col("level"))
            ends = ends.select("grp", "level", _pieces(F.col("a"), F.col("level")).alias("lo"), _pieces(F.col("b"), F.col("level")).alias("hi"))
            same = TAKEN  # identifiers that differ in trailing zero bytes only: the final order decides
        level = ["level"] if stage > 1 else []
        spread = join_one(tied, ends, "grp", n_tied, ["identifier"], hot).withColumn("fate", F.when(F.col("lo") == F.col("hi"), same).otherwise(OPEN))
        begun = scratch.parts(spread.select(*_KEYS, *level, "need", "lo", "hi", "fate"), "pass", "fate")
        passes.append(begun)
        ties.append(begun)
        held = left(begun)
        active, n_open, n_tied = begun.where(F.col("fate") == OPEN).drop("fate"), held.get(OPEN, 0), held.get(TIED, 0)
    out = scratch.table(reduce(DataFrame.unionByName, [p.where(F.col("fate") == TAKEN).select(*_KEYS) for p in passes]), "taken")
    scratch.drop(*passes)
    w = Window.partitionBy("grp").orderBy("minus", "tie", "identifier")
    ranked = out.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)
    return ranked.select(F.col("grp").alias("group_key"), "rank_no", "identifier", (-F.col("minus") + F.lit(0.0)).alias("score"), F.when(F.col("tie") < float("inf"), F.col("tie")).alias("tie"))
