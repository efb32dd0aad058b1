"""Ranks and running sums over a whole table without a single-task window.

Rows are cut into ranges of the ordering key; a window runs inside each range
and is offset by the totals of the ranges before, of which there are at most
``parts``.  Keys that are md5 digests are cut by their first digits, numbers at
approximate quantiles: that affects balance, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .expr import md5_key
from .spread import total_parts


def _offsets(df: DataFrame, groups: Sequence[str], value: Column, descending: bool) -> DataFrame:
    totals = df.groupBy(*groups, "_part").agg(F.sum(value).alias("_n"))
    order = F.desc("_part") if descending else F.asc("_part")
    over = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))


def _with_offsets(df: DataFrame, offsets: DataFrame, groups: Sequence[str]) -> DataFrame:
    same = F.col("_l._part") == F.col("_r._part")
    for g in groups:
        same = same & F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}"))
    return df.alias("_l").join(offsets.alias("_r"), same).select("_l.*", "_r._before")


def shuffled_rank(df: DataFrame, ids: Sequence[str], seed: str, groups: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Place from 1 of each row in the md5 order of its ids, within ``groups``."""
    keyed = df.withColumn("_key", md5_key(ids, seed)).withColumn("_part", F.substring("_key", 1, 3))
    offsets = _offsets(keyed, groups, F.lit(1), False)
    inside = Window.partitionBy(*groups, "_part").orderBy("_key", *ids)
    ranked = _with_offsets(keyed.withColumn("_rank", F.row_number().over(inside)), offsets, groups)
    return ranked.withColumn(name, F.col("_rank") + F.col("_before")).drop("_key", "_part", "_rank", "_before")


def _ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    spot = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    return df.withColumn("_part", spot)


def ordered_rank(df: DataFrame, key: str, ties: Sequence[str] = (), parts: int = 64, name: str = "rn") -> DataFrame:
    """Place from 1 in ascending order of a numeric key (nulls first)."""
    cut = _ranges(df, key, parts)
    offsets = _offsets(cut, (), F.lit(1), False)
    inside = Window.partitionBy("_part").orderBy(key, *ties)
    ranked = _with_offsets(cut.withColumn("_rank", F.row_number().over(inside)), offsets, ())
    return ranked.withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` written in ranges of any orderable key, one a partition, with the range ``_part`` and the place in it ``_at`` from 0.

    The ranges are cut at a sample of the keys themselves, so long common starts
    of texts do no harm; rows with one key share a range.
    """
    placed = df.repartitionByRange(total_parts(df), *order).sortWithinPartitions(*order)
    placed = durable(placed.withColumn("_at", F.monotonically_increasing_id()))  # the partition in the upper 31 bits
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))


def key_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Place from 1 in the order of distinct keys of any type."""
    cut = in_ranges(df, order)
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, key: str, sums: dict[str, str], descending: bool = True, parts: int = 64) -> DataFrame:
    """``df`` with, for each (new, old) of ``sums``, the running sum of old.

    Rows with equal keys must be aggregated before; the key is numeric.
    """
    out = _ranges(df, key, parts)
    order = F.desc(key) if descending else F.asc(key)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = out
    for new, old in sums.items():
        offsets = _offsets(base, (), F.col(old), descending)
        out = _with_offsets(out.withColumn(new, F.sum(old).over(inside)), offsets, ())
        out = out.withColumn(new, F.col(new) + F.col("_before")).drop("_before")
    return out.drop("_part")


def neighbours(df: DataFrame, key: str, columns: Sequence[str], parts: int = 64) -> DataFrame:
    """``df`` with ``prev_<c>``: column c of the row before, by ascending key.

    Keys are distinct.  Only the last row of a range crosses to the next.
    """
    cut = _ranges(df, key, parts)
    inside = Window.partitionBy("_part").orderBy(key)
    lasts = cut.groupBy("_part").agg(F.max(F.struct(F.col(key).alias("_key"), *columns)).alias("_last"))
    over = Window.partitionBy(F.lit(0)).orderBy("_part")
    lasts = lasts.select(F.col("_part"), F.lag("_last").over(over).alias("_last"))
    out = cut.withColumn("_first", F.row_number().over(inside) == 1)
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(inside))
    out = out.alias("_l").join(lasts.alias("_r"), F.col("_l._part") == F.col("_r._part")).select("_l.*", "_r._last")
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_last.{c}")).otherwise(F.col(f"prev_{c}")))
    return out.drop("_part", "_first", "_last")


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = 10_000) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of each column; nulls and NaN aside."""
    return quantiles_and(df, columns, probabilities, (), limit)[0]


def quantiles_and(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], aggregates: Sequence[Column],
                  limit: int = 10_000) -> tuple[dict[str, list[float | None]], tuple]:
    """``quantiles``, and ``aggregates`` of the same scan.

    The first scan counts and makes one sketch a column, which gives two values
    around each quantile; the second counts the rows below and at them, which
    tells whether the sought ranks are at one of the two or between them; the
    third gathers what lies strictly between.  Only brackets of at most ``limit``
    rows are gathered: larger ones (beyond some ten million rows) are narrowed by
    further sketches and counts, and always shrink, as their ends go.  Every scan
    serves all columns, and no task holds a column's values.
    """
    number = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    around = [s for p in probabilities for s in (max(0.0, p - 4e-4), min(1.0, p + 4e-4))]
    row = df.agg(*[F.count(number[c]).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[F.percentile_approx(number[c], around, 10_000).alias(f"q{i}") for i, c in enumerate(columns)], *aggregates).first()
    sizes = {c: row[i] for i, c in enumerate(columns)}
    ranks = {(c, p): (sizes[c] - 1) * p for c in columns for p in probabilities if sizes[c]}
    sketched: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(columns):
        for j, p in enumerate(probabilities if sizes[c] else ()):
            for rank in (math.floor(ranks[c, p]), math.ceil(ranks[c, p])):
                sketched.setdefault((c, rank), tuple(row[len(columns) + i][2 * j : 2 * j + 2]))
    value: dict[tuple[str, int], float] = {}
    inside = {t: (None, None, 0, sizes[t[0]]) for t in sketched}  # ends (None: open), rows before, rows strictly between

    def between(t: tuple[str, int]) -> Column:
        low, high, _, _ = inside[t]
        x, test = number[t[0]], F.lit(True)
        test = test if low is None else test & (x > F.lit(low))
        return F.when(test if high is None else test & (x < F.lit(high)), x)

    active = [t for t in inside if inside[t][3] > limit]
    while active:
        sums = []
        for i, t in enumerate(active):
            x, (low, high) = number[t[0]], sketched[t]
            sums += [F.sum(test.cast("long")).alias(f"{k}{i}") for k, test in (("a", x < F.lit(low)), ("b", x <= F.lit(low)), ("c", x < F.lit(high)), ("d", x <= F.lit(high)))]
        counts = df.agg(*sums).first()
        for i, t in enumerate(active):
            (low, high), rank = sketched[t], t[1]
            a, b, c, d = (counts[f"{k}{i}"] for k in "abcd")
            left, right, before, size = inside[t]
            if rank < a:
                inside[t] = (left, low, before, a - before)
            elif rank < b:
                value[t] = low
            elif rank < c:
                inside[t] = (low, high, b, c - b)
            elif rank < d:
                value[t] = high
            else:
                inside[t] = (high, right, d, before + size - d)
        active = [t for t in active if t not in value and inside[t][3] > limit]
        if active:
            shares = [(max(0.0, (t[1] - inside[t][2]) / inside[t][3] - 3e-4), min(1.0, (t[1] + 1 - inside[t][2]) / inside[t][3] + 3e-4)) for t in active]
            near = df.agg(*[F.percentile_approx(between(t), list(s), 10_000) for t, s in zip(active, shares, strict=True)]).first()
            sketched.update({t: tuple(near[i]) for i, t in enumerate(active)})
    open_brackets = list(dict.fromkeys((t[0], *inside[t][:2]) for t in inside if t not in value))
    if open_brackets:
        place = {b: i for i, b in enumerate(open_brackets)}
        cells = F.array(*[F.struct(F.lit(i).alias("i"), between(next(t for t in inside if t not in value and (t[0], *inside[t][:2]) == b)).alias("x")) for b, i in place.items()])
        tall = df.select(F.explode(F.filter(cells, lambda c: c["x"].isNotNull())).alias("c")).groupBy("c.i", "c.x").agg(F.count(F.lit(1)).alias("n"))
        held: dict[int, list[tuple[float, int]]] = {}
        for r in tall.collect():
            held.setdefault(r["i"], []).append((r["x"], r["n"]))
        for t in inside:
            if t not in value:
                seen = inside[t][2]
                for x, m in sorted(held[place[(t[0], *inside[t][:2])]]):
                    if seen <= t[1] < seen + m:
                        value[t] = x
                    seen += m
    found = {}
    for (c, p), at in ranks.items():
        a, b = value[c, math.floor(at)], value[c, math.ceil(at)]
        found[c, p] = a + (b - a) * (at - math.floor(at))
    return {c: [found.get((c, p)) for p in probabilities] for c in columns}, tuple(row)[2 * len(columns) :]
