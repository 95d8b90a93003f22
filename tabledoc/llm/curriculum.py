"""Mixing sources to target weights that change over the training.

Every source has a schedule, its weight as a piecewise linear function of training time 0 to 1.  The
integral of the schedule is the source's weight in the mix: it sets how many words the mix takes of the
source, at most a number of times its size, with the excess shared among the others.  The source's
documents, in an order drawn by hash and gone through as often as needed, lie along its cumulative demand of
words; inverting the demand at the middle of a document gives the time at which the document is due.  The
documents of all sources are then range-sorted by that time.

Sources are ranked and levelled as a table of one row each.  Running sums inside a source are made in
buckets of bounded size (``operators.ordered``), so a source may hold most rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.llm.joins import small_side
from tabledoc.operators.ordered import numbered
from tabledoc.session import materialise

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, numbers only, that order a source in one task, about; beyond ``ordered.MOST_BUCKETS`` buckets they grow.
BUCKET_ROWS = 1 << 12
#: Rows of the table of sources that may be broadcast.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Schedule:
    """Weights at rising times from 0 to 1, joined by straight lines; some weight must be above 0."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        times = [t for t, _ in self.knots]
        if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
            raise ValueError("the times of a schedule rise from 0 to 1")
        if any(not 0 <= w < math.inf for _, w in self.knots) or not self.integral:
            raise ValueError("the weights of a schedule are finite, none is negative and one is above 0")

    @property
    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """Of each straight line: its start, weight there, slope, length and the integral before it."""
        out, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            out.append((t0, w0, (w1 - w0) / (t1 - t0), t1 - t0, before))
            before += (w0 + w1) / 2 * (t1 - t0)
        return out

    @property
    def integral(self) -> float:
        return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]))

    def time_of(self, share: Column) -> Column:
        """The time by which ``share`` (0 to 1) of the integral is used up."""
        area, found = share * self.integral, None
        for start, weight, slope, length, before in reversed(self.pieces):
            rest = F.greatest(area - before, F.lit(0.0))
            # the root of weight * x + slope / 2 * x^2 = rest, in the form without cancellation
            below = weight + F.sqrt(F.greatest(weight * weight + 2 * slope * rest, F.lit(0.0)))
            at = F.when(below > 0, start + F.least(2 * rest / below, F.lit(length))).otherwise(F.lit(start))
            found = at if found is None else F.when(area >= after, found).otherwise(at)
            after = before
        return found


#: Weights 5, 2 and 1: one that fades, one that stays, one that grows.
SCHEDULES = (Schedule(((0.0, 7.0), (1.0, 3.0))), Schedule(((0.0, 2.0), (1.0, 2.0))), Schedule(((0.0, 0.0), (1.0, 2.0))))


def _ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``nth``, the number of a source (from 0) by code point, null last."""
    order = F.col("_source").asc_nulls_last()
    placed = sources.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialise(
        placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sources"
    )
    # one number of each partition
    counts = {r["_part"]: (r["n"], r["low"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect()}
    shifts, so_far = [], 0
    for part in sorted(counts):
        n, low = counts[part]
        shifts.append((part, so_far - low))
        so_far += n
    shift = sources.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    return placed.join(shift, "_part").select("_source", "_source_size", (F.col("_at") + F.col("_shift")).alias("nth"))


def _level(sources: DataFrame, budget: float, cap: Column) -> float:
    """The words for each unit of weight, once what exceeds the caps is shared among the other sources."""
    level, above = 0.0, F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free")
        ).first()
        if not row["free"]:
            return math.inf
        found = (budget - row["capped"]) / row["free"]
        if found <= level:
            return level
        level, above = found, F.col("weight") * found > cap


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", schedules: tuple[Schedule, ...] = SCHEDULES,
    choose: Column | None = None, share: float = 1.5, repeats: int = 2, seed: str = "", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``docs`` with the words that the mix takes of it, range-sorted by training time.

    Gives the key, ``size`` (words of the text), ``source_size``, ``target`` (words to take of the source),
    ``taken`` (words taken of this row, at most ``repeats`` times its size), ``position`` (time of its first copy, null and
    last if none is taken) and ``copies``, an array of (position, words).  The sources share ``share`` times all
    words by the integrals of their schedules, none above ``repeats`` times its size.  A source takes its target rounded
    to a word: all copies are whole but the last, of which the first words are taken.  ``choose`` gives the
    schedule's index from ``nth``, the number of the source by code point with null last; by default the schedules repeat.

    A null text has no words, a null source is a source of its own, null and repeated keys are rows like others.
    A hash of key, size and ``seed`` orders a source, and rows that agree in them lie next to each other, so reruns agree.
    Texts stay where they are, only numbers are shuffled, unless ``carry`` names columns to go along; of these, names of added
    columns are left out.  No rows give no rows.  A text of any length is counted in one row.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    added = ("size", "source_size", "target", "taken", "position", "copies")
    kept = [c for c in dict.fromkeys(carry) if c not in (key, *added)]
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").cast("string").alias("_source"), size.alias("_size"),
        *([F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_carried")] if kept else []),
    )
    # 52 bits, so that a double holds the order exactly
    name = F.concat(F.lit(seed), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(":"), F.col("_size").cast("string"))
    drawn = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows = materialise(rows.withColumns({"_drawn": drawn, "_serial": F.monotonically_increasing_id()}), "mix")

    sources = _ranked_sources(rows.groupBy("_source").agg(F.sum("_size").alias("_source_size")))
    which = F.pmod(choose if choose is not None else F.col("nth"), F.lit(len(schedules))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(s.integral)) for s in schedules]), which + 1)
    cap = F.col("_source_size") * repeats
    sources = materialise(sources.select("_source", "_source_size", which.alias("schedule"), weight.alias("weight")), "sources")
    total = sources.agg(F.sum("_source_size")).first()[0] or 0
    level = _level(sources, share * total, cap) if total else 0.0
    sources = sources.withColumn("_target", F.least(cap.cast("double"), F.col("weight") * level) if total else F.lit(0.0))

    placed = numbered(rows, ["_source"], "_drawn", out=None, running={"_upto": "_size"}, tie="_serial", size=BUCKET_ROWS).alias("a")
    known = small_side(sources, most=BROADCAST_SOURCES).alias("b")
    whole = F.floor(F.col("_target") + 0.5)
    out = placed.join(known, F.col("a._source").eqNullSafe(F.col("b._source")))

    def copy(nth: int) -> Column:
        begin = F.col("_upto") - F.col("_size") + nth * F.col("_source_size")
        words = F.least(whole - begin, F.col("_size"))
        done = (begin + words / 2) / whole
        at = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            at = F.when(F.col("schedule") == i, schedule.time_of(done)).otherwise(at)
        return F.when(words > 0, F.struct(at.alias("position"), words.cast("long").alias("words")))

    copies = F.array_compact(F.array(*[copy(n) for n in range(repeats)]))
    out = out.withColumn("copies", copies).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.get("copies", F.lit(0))["position"].alias("position"), "copies", *[F.col("_carried")[c].alias(c) for c in kept], "_drawn",
    )
    order = [F.col("position").asc_nulls_last(), F.col("_drawn")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("_drawn")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy of ``mix``, range-sorted: ``copy`` (from 0), its ``position`` and ``words``, and the other columns."""
    others = [c for c in mixed.columns if c not in ("position", "copies", "taken", "copy", "words")]
    each = mixed.select(*[F.col(f"`{c}`") for c in others], F.posexplode("copies").alias("copy", "_c"))
    each = each.select(*[F.col(f"`{c}`") for c in others], "copy", F.col("_c.position").alias("position"), F.col("_c.words").alias("words"))
    order = [F.col("position"), F.col(f"`{others[0]}`"), F.col("copy")]
    return each.repartitionByRange(*order).sortWithinPartitions(*order)
