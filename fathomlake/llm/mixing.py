"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in a fixed pseudo-random order and cut into blocks.
Block i (from 1) of a source with target share w gets the release time
``floor((i - 1) / w)`` and the deadline ``ceil(i / w)`` on a timeline with one
block a slot.  Earliest deadline first among the released blocks then serves
every block inside its window (total share is 1), so after any number t of
slots each source has been given more than ``w * t - 1`` and less than
``w * t + 1`` blocks.

Weights are integers here, so the schedule repeats after ``sum(weights)``
slots: only that one period is worked out, on the driver, and its size depends
on the weights alone.  When a source runs out, the period is worked out anew
for the rest, and the bound holds from there on.  Every row gets a place:
nothing is dropped or repeated, whatever the weights.

Sources that the weights do not name (null among them) form one further source
with weight ``rest``.  A hot source is no single task: rows are ranked inside
``buckets`` parts of their hash and offset by the counts of the parts before.
The order of a source's rows is (part, hash, key), where the hash is that of the
key and of every other column given.  So it does not depend on the layout, and
rows whose keys are null or repeated spread like any others as long as they
differ in some column; rows that differ in none are interchangeable, and share
a part.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REST = "*"
#: The longest period: with it the plan has at most this many rows a phase.
MAX_PERIOD = 10_000
ADDED = ["_mix_source", "_block", "_release", "_deadline", "_slot", "_row"]


def period(weights: Mapping[str, int]) -> list[str]:
    """The source served in each slot of one period of ``sum(weights)`` slots."""
    total, given, slots = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(total):
        ready = []
        for name, w in weights.items():
            share = Fraction(w, total)
            release = given[name] // share
            if given[name] < w and release <= t:
                deadline = -(-(given[name] + 1) // share)
                ready.append((deadline, -w, name))
        _, _, name = min(ready)
        given[name] += 1
        slots.append(name)
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple]:
    """Spans of slots between which sources run out.

    A row is (source, place in the period, blocks of the source before it in
    the period, blocks a period, first block of the phase, last block of the
    phase, first slot of the phase, slots a period); blocks and slots from 0.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, rows = dict.fromkeys(left, 0), 0, []
    while left:
        active = {s: weights[s] for s in left}
        slots = period(active)
        places = {s: [i for i, x in enumerate(slots) if x == s] for s in active}
        whole = len(slots)
        ends = {s: (n - 1) // active[s] * whole + places[s][(n - 1) % active[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        for s in active:
            served = length // whole * active[s] + sum(p < length % whole for p in places[s])
            served = min(served, left[s])
            if served:
                rows += [(s, p, i, active[s], done[s], done[s] + served - 1, start, whole)
                         for i, p in enumerate(places[s])]
            done[s] += served
            left[s] -= served
        start += length
        left = {s: n for s, n in left.items() if n > 0}
    return rows


def mix(
    df: DataFrame,
    weights: Mapping[str, int],
    rest: int = 1,
    block_rows: int = 64,
    source_col: str = "source",
    key_cols: tuple[str, ...] = ("doc_id",),
    buckets: int = 1024,
) -> DataFrame:
    """``df`` with its place in the mixture.

    Columns of ``df`` that are named like an added one are replaced.
    Added columns: _mix_source (the source, or ``*`` for the rest), _block
    (number in the source, from 0), _release and _deadline (the block's window
    on the timeline of the sources that are left; its slot lies in it), _slot
    (place of the block in the mixture, from 0) and _row (place of the row in
    the block).
    """
    spark = df.sparkSession
    others = [f"`{f.name}`" for f in df.schema.fields if f.name not in (*key_cols, *ADDED) and "map<" not in f.dataType.simpleString()]
    weights = {**{str(k): int(v) for k, v in weights.items()}, REST: int(rest)}
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive integers")
    if sum(weights.values()) > MAX_PERIOD:
        raise ValueError(f"weights must sum to at most {MAX_PERIOD}: the period is worked out on the driver")
    named = F.array(*[F.lit(s) for s in weights if s != REST])
    source = F.when(F.array_contains(named, F.col(source_col)), F.col(source_col)).otherwise(F.lit(REST))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_given"),
        source.alias("_mix_source"),
        F.xxhash64(*key_cols, *others).alias("_spread"),
        F.struct(*key_cols).alias("_key"),
    ).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_spread", 20), F.lit(buckets)).cast("int"))

    counts = rows.groupBy("_mix_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = {r[0]: -(-r[1] // block_rows) for r in counts.groupBy("_mix_source").agg(F.sum("_n")).collect()}

    inside = Window.partitionBy("_mix_source", "_bucket").orderBy("_spread", "_key")
    ranked = (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["_mix_source", "_bucket"])  # at most sources x buckets rows
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumns({"_block": F.floor(F.col("_rank") / block_rows).cast("long"),
                      "_row": F.pmod("_rank", F.lit(block_rows)).cast("int")})
    )
    plan = spark.createDataFrame(
        phases(weights, sizes),
        "p_source string, place long, nth long, per long, lo long, hi long, start long, whole long",
    )
    # Both sides are bounded by the weights: a row a source and phase, then one more for each block of a period.
    spans = F.broadcast(plan.groupBy("p_source", "lo", "hi", "per", "start", "whole").agg(F.count(F.lit(1)))).alias("p")
    places = F.broadcast(plan.select(F.col("p_source").alias("_mix_source"), "lo", "nth", "place"))
    in_phase = (F.col("_mix_source") == F.col("p.p_source")) & F.col("_block").between(F.col("p.lo"), F.col("p.hi"))
    timed = ranked.join(spans, in_phase).withColumn("nth", F.pmod(F.col("_block") - F.col("lo"), F.col("per")))
    slot = F.col("start") + F.floor((F.col("_block") - F.col("lo")) / F.col("per")) * F.col("whole") + F.col("place")
    return (
        timed.join(places, ["_mix_source", "lo", "nth"])
        .withColumns({
            "_slot": slot.cast("long"),
            "_release": (F.col("start") + F.floor((F.col("_block") - F.col("lo")) * F.col("whole") / F.col("per"))).cast("long"),
            "_deadline": (F.col("start") + F.ceil((F.col("_block") - F.col("lo") + 1) * F.col("whole") / F.col("per"))).cast("long"),
        })
        .select(*[F.col("_given")[c].alias(c) for c in df.columns if c not in ADDED], *ADDED)
    )


def in_mixture_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of what ``mix`` returns, laid out in the order of the mixture."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "_slot", "_row").sortWithinPartitions("_slot", "_row").select(*columns)
