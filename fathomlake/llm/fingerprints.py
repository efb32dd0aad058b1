"""Document fingerprints: bottom-k sketches of hashed word shingles.

A text's shingles are its runs of five words (the whole sequence where it has
fewer, none where it has no word).  Each is hashed to a signed 64-bit value
that is uniform over the range; the sketch is the ``k`` smallest distinct
values in ascending order.  Sketches depend on the set of shingles alone, so

* the sketch of a union is the ``k`` smallest of the sketches' union: they
  merge across parts in any order (``merge``);
* the share of the union's ``k`` smallest that both sketches hold estimates
  resemblance (``resemblance``), exactly where both hold fewer than ``k``;
* ``(k - 1) / (k-th value mapped to 0..1)`` estimates the number of distinct
  shingles (``distinct_shingles``), and with it containment.

Two empty sketches resemble each other fully, an empty one and another not at
all.  Null text counts as empty.  Everything is DataFrame functions; each row
is sketched alone, so no shuffle and no skew.  ``compare_with_edits`` joins rows
of neighbouring ids; ids that hold many rows (null, say) are dealt by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, durable, join_spread, let, split_words, text_or_empty

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
SPACES = r"\s+"


def _shingle_hashes(words: Column, size: int) -> Column:
    """One hash a shingle, repeats included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n <= size, F.array(F.xxhash64(h)))
            .otherwise(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(h, i, size))))
        )

    return let(hashed, runs)


def sketch(text: Column, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS) -> Column:
    """The text's sketch: at most ``k`` ascending bigints."""
    hashes = _shingle_hashes(split_words(text_or_empty(text), SPACES), size)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch a group.

    Distinct values are ranked in (group, slice of the hash range) first: only
    the ``k`` smallest of a slice go on, so a group with a third of all rows is
    spread over 64 slices and its final merge sees at most ``64 * k`` values.
    """
    part = F.shiftrightunsigned(F.col("v"), 58)
    values = df.select(*keys, F.explode(sketch_col).alias("v")).distinct().withColumn("part", part)
    in_part = Window.partitionBy(*keys, "part").orderBy("v")
    few = values.withColumn("r", F.row_number().over(in_part)).filter(F.col("r") <= k)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("v")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    shared = let(
        merge(a, b, k),
        lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double") / F.greatest(F.size(u), F.lit(1)),
    )
    return F.when(both_empty, F.lit(1.0)).otherwise(shared)


def distinct_shingles(s: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's distinct shingles that b holds, 0 to 1."""
    j = resemblance(a, b, k)
    shared = j / (1.0 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """The sketch as lower-case hex, 16 digits a value."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def next_ids(df: DataFrame, id_col: str, blocks: int = 256) -> DataFrame:
    """Each distinct id with the next smaller one; the smallest has the largest.

    Ids are cut into ranges at quantiles and ``lead`` runs inside each range;
    only one row a range crosses over to its neighbour.  Columns: id, next_id.
    """
    ids = df.select(F.col(id_col).alias("id")).distinct()
    cuts = ids.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    spot = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    ids = ids.withColumn("part", spot)
    edges = ids.groupBy("part").agg(F.max("id").alias("top"))
    over = Window.orderBy(F.desc("part"))  # a row a range: at most ``blocks``
    first = F.first("top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = edges.select("part", F.coalesce(F.lead("top").over(over), first).alias("below"))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id")))
    return (
        ids.withColumn("inside", inside)
        .join(F.broadcast(edges), "part")
        .select("id", F.coalesce("inside", "below").alias("next_id"))
    )


def compare_with_edits(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS
) -> DataFrame:
    """Fingerprint every text and an edited one whose last third is replaced.

    The replacement is the beginning of the next document by descending id.
    Where several rows have one id, the one with the smallest text hash lends
    its beginning; a null id counts as the smallest.  The texts are dealt out by
    id (and text, where many have one id) once and that exchange serves both
    joins; beginnings travel back alone.

    Columns: id, text, n_chars, edited, sketch, edited_sketch, next_sketch.
    """
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                      text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("_h", F.xxhash64("text"))
    third = (F.length("text") / 3).cast("int")
    needs = durable(texts.select("id", third.alias("n")).groupBy("id").agg(F.max("n").alias("need"), F.count(F.lit(1)).alias("_n")))
    sizes, total = needs.select("id", "_n"), needs.agg(F.sum("_n")).first()[0] or 0
    pairs = durable(next_ids(needs, "id").join(needs.drop("_n"), "id"))
    asked = pairs.select(F.col("next_id").alias("id"), F.col("id").alias("for_id"), "need")  # each id follows one
    lent = (  # no column but id and text is asked for here and below, so that one exchange serves both joins
        join_spread(texts, asked, ["id"], "_h", sizes, total)
        .select(F.col("for_id").alias("id"), F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, need)").alias("head"),
                                                      sketch(F.col("text"), k, size).alias("sketch")).alias("lent"))
        .groupBy("id").agg(F.min("lent").alias("lent"))
    )
    edited = F.concat(F.expr("left(text, length(text) - cast(length(text) / 3 as int))"),
                      F.expr("left(lent.head, cast(length(text) / 3 as int))"))
    return (
        join_spread(texts, lent, ["id"], "_h", sizes, total)
        .select("id", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
                sketch(F.col("text"), k, size).alias("sketch"), F.col("lent.sketch").alias("next_sketch"))
        .withColumn("edited_sketch", sketch(F.col("edited"), k, size))
        .select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "text", "n_chars", "edited",
                "sketch", "edited_sketch", "next_sketch")
    )
