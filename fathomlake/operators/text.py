"""Word n-grams, vocabulary and count vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import durable
from ..functions.ordered import key_rank
from ..functions.spread import total_parts


def tokens(text: str) -> Column:
    """Lower-case runs of word characters; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    last = F.size(words) - n
    made = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def gram_counts(df: DataFrame, row_id: str, text: str, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """row_id, gram, n."""
    split = df.select(row_id, tokens(text).alias("_w"))
    many = split.select(row_id, F.explode(F.concat(*[ngrams(F.col("_w"), n) for n in sizes])).alias("gram"))
    return many.groupBy(row_id, "gram").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, row_id: str, min_documents: int = 1) -> DataFrame:
    """gram, documents, total and a dense index by falling total, then gram.

    ``counts`` has a row for each gram of a row.  Grams are ranked in ranges of
    (total, gram), so that the many grams seen once are no single task.
    """
    words = counts.groupBy("gram").agg(F.count(row_id).alias("documents"), F.sum("n").alias("total")).filter(F.col("documents") >= min_documents)
    ranked = key_rank(words, [F.desc("total"), F.asc("gram")], "index")
    return ranked.select("gram", "documents", "total", (F.col("index") - 1).alias("index"))


def count_vectors(counts: DataFrame, words: DataFrame, row_id: str) -> DataFrame:
    """row_id, index, n of the grams in the vocabulary: sparse vectors, a row a cell."""
    return counts.join(words.select("gram", "index"), "gram").select(row_id, "index", "n")


def _posted(part: pa.RecordBatch, sizes: tuple[int, ...], cells: bool) -> Iterator[pa.RecordBatch]:
    """The grams of some rows (id, words): a row a gram."""
    words, lengths = part.column(1).flatten(), pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(part.num_rows), lengths)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    here = codes
    for n in range(1, max(sizes) + 1):
        if n > 1:
            here = np.unique(here[:-1] * len(coded.dictionary) + codes[n - 1 :], return_inverse=True)[1].astype(np.int64)
        at = np.flatnonzero(doc[: len(here)] == doc[n - 1 :])
        if n not in sizes or not len(at):
            continue
        at = at[np.argsort(here[at], kind="stable")]
        gram, of = here[at], doc[at]
        fresh = np.concatenate([[True], gram[1:] != gram[:-1]])
        cell = np.flatnonzero(fresh | np.concatenate([[True], of[1:] != of[:-1]]))
        counts = np.diff(cell, append=len(at))
        first = np.flatnonzero(fresh[cell])  # of the cells of a gram
        texts = [words.take(pa.array(at[cell[first]] + i)) for i in range(n)]
        out = [texts[0] if n == 1 else pc.binary_join_element_wise(*texts, " "), pa.array(np.diff(first, append=len(cell))), pa.array(np.add.reduceat(counts, first))]
        if cells:
            ends = pa.array(np.append(first, len(cell)).astype(np.int32))
            out += [pa.ListArray.from_arrays(ends, part.column(0).take(pa.array(of[cell]))), pa.ListArray.from_arrays(ends, pa.array(counts))]
        yield pa.RecordBatch.from_arrays(out, names=["gram", "documents", "total", "ids", "ns"][: len(out)])


def gram_postings(df: DataFrame, row_id: str, text: str, sizes: tuple[int, ...] = (1, 2), cells: bool = True, words: int = 1_000_000) -> DataFrame:
    """gram, documents, total, and with ``cells`` the lists ids and ns: several rows a gram, each of other row ids.

    Rows are counted where they are read, some ``words`` words at a time, so
    that a gram's text is moved once for many rows.  Only rows whose id comes
    again, or is null, are brought together first.
    """
    split = df.select(row_id, tokens(text).alias("_w"))
    again = durable(df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(row_id).isNull()).select(F.col(row_id).alias("_id")))
    same = F.col(row_id).eqNullSafe(F.col("_id"))
    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("total", T.LongType())])
    if cells:
        kind = kind.add("ids", T.ArrayType(df.schema[row_id].dataType)).add("ns", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + words, side="right")))
                yield from _posted(batch.slice(at, stop - at), sizes, cells)
                at = stop

    plain = split if again.isEmpty() else split.join(again, same, "left_anti")
    posted = plain.mapInArrow(run, kind)
    if again.isEmpty():
        return posted
    counted = gram_counts(df.join(again, same, "left_semi"), row_id, text, sizes)
    lists = [F.array(row_id).alias("ids"), F.array("n").alias("ns")] if cells else []
    return posted.unionByName(counted.select("gram", F.lit(1).cast("long").alias("documents"), F.col("n").alias("total"), *lists))


def posted_vocabulary(postings: DataFrame, min_documents: int = 1) -> DataFrame:
    """``vocabulary`` of postings."""
    words = postings.groupBy("gram").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).filter(F.col("documents") >= min_documents)
    ranked = key_rank(words, [F.desc("total"), F.asc("gram")], "index")
    return ranked.select("gram", "documents", "total", (F.col("index") - 1).alias("index"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, total, at, fresh, ids, ns of the postings (gram, total, ids, ns) of a range of grams, sorted by gram.

    ``at`` is the place of the gram among those of its range and total, ``fresh`` is its first posting.
    """
    part, seen, last, place = TaskContext.get().partitionId(), {}, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, total = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        turns = pc.not_equal(gram.slice(1), gram.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[gram[0].as_py() != last], turns]).astype(bool)
        kinds, of = np.unique(total[fresh], return_inverse=True)
        counts, order = np.bincount(of, minlength=len(kinds)), np.argsort(of, kind="stable")
        at = np.empty(len(of), np.int64)
        at[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at += np.array([seen.get(k, 0) for k in kinds.tolist()], np.int64)[of]
        seen.update({k: seen.get(k, 0) + n for k, n in zip(kinds.tolist(), counts.tolist(), strict=True)})
        places = np.concatenate([[place], at])[np.cumsum(fresh)]
        last, place = gram[-1].as_py(), int(places[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column(1), pa.array(places), pa.array(fresh), *batch.columns[2:]],
                                         names=["part", "total", "at", "fresh", "ids", "ns"])


def posted_vectors(df: DataFrame, row_id: str, text: str, sizes: tuple[int, ...] = (1, 2), known: int = 200_000) -> DataFrame:
    """row_id, index, n: ``count_vectors`` by the vocabulary of all grams.

    Postings move once, to ranges of grams.  There a gram's index needs but its
    place among those of its total and how many grams come before these: a row a
    range and total, joined by broadcast if there are at most ``known``.
    """
    postings = gram_postings(df, row_id, text, sizes).select("gram", "total", "ids", "ns")
    ranged = postings.repartitionByRange(total_parts(df), "gram").withColumn("total", F.sum("total").over(Window.partitionBy("gram")))
    lists = [T.StructField("ids", T.ArrayType(df.schema[row_id].dataType)), T.StructField("ns", T.ArrayType(T.LongType()))]
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("at", T.LongType()), T.StructField("fresh", T.BooleanType()), *lists])
    placed = durable(ranged.mapInArrow(_placed, kind))
    counts = durable(placed.filter("fresh").groupBy("total", "part").agg(F.count(F.lit(1)).alias("_n")))
    of_totals = counts.groupBy("total").agg(F.sum("_n").alias("_n"))  # as many rows as different totals
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    of_totals = of_totals.select("total", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_higher"))
    lower = Window.partitionBy("total").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("total", "part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower")).join(of_totals, "total")
    before = before.select("total", "part", (F.col("_higher") + F.col("_lower")).alias("_before"))
    met = placed.join(F.broadcast(before) if counts.count() <= known else before, ["total", "part"])
    cells = met.select((F.col("_before") + F.col("at")).alias("index"), F.explode(F.arrays_zip("ids", "ns")).alias("c"))
    return cells.select(F.col("c.ids").alias(row_id), "index", F.col("c.ns").alias("n"))
