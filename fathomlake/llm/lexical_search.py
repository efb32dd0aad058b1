"""Ranked lexical search by block-max pruning.

Documents are cut into ranges of at most ``BLOCK_DOCS`` rows.  A block of the
index holds a forward index (of each document its terms with their impacts) and
the largest impact of each term.  A query's bound on a block is its weighted sum
of those maxima; blocks are taken by falling bound and scored from the forward
index until the bound is below the threshold, the score of the k-th best so far.

As Spark jobs: one scan of the texts writes the forward index of the queries'
terms, sums of it give the statistics of all documents, one pass turns
occurrences into impacts and maxima.  A first pass reads only the maxima and
names for every query the blocks of largest bound; these are scored and give
each query a threshold that holds for all documents.  The last pass prunes with
it in every task.  Rows are never shuffled by a key but for the few best of each
query, so copies and hot keys stay where they are.

Score (64-bit integers, ``//`` rounds down): a document of n terms has
m = 10 + (90 * n * N) // L, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))),
and the score is the sum of w * ((10^9 tf) // (1000 tf + 8 m)) over the query's
distinct terms.  N counts the documents with a term and L their terms.

The queries are gathered on the driver in parts of at most ``MAX_BYTES`` of text,
each searched on its own, so any number of queries can be given.

Defined results.  Null and empty texts hold no term: such documents are not
counted and never found, such queries find nothing.  A score of 0 is not found.
Every query row has ranks of its own, also where ids are null or repeated; every
document row stands for itself.  Equal scores are ordered by ascending document
id, null first; ranks are unique.  Empty tables give no rows.  Other columns of
either table are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_words
from .common import NULL_ID, durable, parts_within, text_or_empty

#: Documents of a block, blocks whose scores give the first threshold of a query, and how many of them a task names.
BLOCK_DOCS = 16
SEEDS = 128
NAMED = 32
#: Bytes of query texts searched at once.
MAX_BYTES = 4 << 20
#: Numbers in the table of maxima (blocks x terms) that a task holds at once.
CELLS = 1 << 22

_FORWARD = "docs long, words long, ids array<long>, lengths array<int>, sizes array<int>, terms array<int>, counts array<int>"
_INDEX = "block long, ids array<long>, sizes array<int>, terms array<int>, impacts array<int>, top_terms array<int>, tops array<int>"


@dataclass(frozen=True)
class Queries:
    """Queries as places of their terms in the list of all terms."""

    rows: np.ndarray  # the number of each one's row
    terms: list[bytes]
    of: list[np.ndarray]


def gather(rows: DataFrame) -> Queries:
    """The queries of (nr, text as bytes), on the driver; the caller has checked their size."""
    listed = rows.collect()
    own = byte_words.read([bytes(r[1]) for r in listed])
    words = [own.data[a:b].tobytes() for a, b in zip(own.starts, own.ends, strict=True)]
    terms = sorted(set(words))
    place = {t: i for i, t in enumerate(terms)}
    held: list[set[int]] = [set() for _ in listed]
    for row, word in zip(own.row, words, strict=True):
        held[row].add(place[word])
    return Queries(np.array([r[0] for r in listed], np.int64), terms, [np.array(sorted(h), np.int64) for h in held])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def forward_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row a block: how many documents and words it has, and the counts of ``terms``.

    ``docs`` and ``words`` count all documents that have a word; the lists hold
    those that have one of the terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = byte_words.Terms(sent.value)
        width = max(1, len(sent.value))
        for batch in batches:
            at, ids = 0, batch.column(0).to_numpy()
            for texts in byte_words.slices(v.as_py() for v in batch.column(1)):
                words = byte_words.read(texts, lookup.seed)
                lengths = np.bincount(words.row, minlength=len(texts))
                spots, places = lookup.match(words)
                pairs, counts = np.unique(words.row[spots] * width + places, return_counts=True)
                rows = pairs // width
                sizes = np.bincount(rows, minlength=len(texts))
                firsts = np.concatenate([[0], np.cumsum(sizes)])
                own = ids[at : at + len(texts)]
                at += len(texts)
                out: list[list] = [[] for _ in range(7)]
                for a in range(0, len(texts), block_docs):
                    b = min(a + block_docs, len(texts))
                    kept = np.flatnonzero(sizes[a:b]) + a
                    mine = slice(firsts[a], firsts[b])
                    for column, value in zip(out, (int((lengths[a:b] > 0).sum()), int(lengths[a:b].sum()), own[kept], lengths[kept], sizes[kept],
                                                   pairs[mine] % width, counts[mine]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     *[_lists(np.concatenate(c), np.array([len(x) for x in c]), t)
                       for c, t in zip(out[2:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]],
                    names=["docs", "words", "ids", "lengths", "sizes", "terms", "counts"])

    return given.mapInArrow(run, _FORWARD).filter("docs > 0")


def _document_counts(forward: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "n"])

    out = np.zeros(width, np.int64)
    for term, n in forward.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The lists of a column."""
    column = batch.column(batch.schema.get_field_index(name))
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def block_index(forward: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The blocks with impacts in place of counts, and of each term its largest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            impacts, top_terms, tops = [], [], []
            for lengths, sizes, terms, counts in zip(*(_arrays(batch, c) for c in ("lengths", "sizes", "terms", "counts")), strict=True):
                m, counts = np.repeat(10 + 90 * lengths.astype(np.int64) * n_docs // n_words, sizes), counts.astype(np.int64)
                own = (1_000_000_000 * counts // (1000 * counts + 8 * m)).astype(np.int32)  # under a million
                order = np.argsort(terms, kind="stable")
                cuts = np.flatnonzero(np.diff(terms[order], prepend=-1))
                impacts.append(own)
                top_terms.append(terms[order][cuts])
                tops.append(np.maximum.reduceat(own[order], cuts))
            n = [len(x) for x in impacts], [len(x) for x in tops]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("block", "ids", "sizes", "terms")), _lists(np.concatenate(impacts), np.array(n[0]), pa.int32()),
                 _lists(np.concatenate(top_terms), np.array(n[1]), pa.int32()), _lists(np.concatenate(tops), np.array(n[1]), pa.int32())],
                names=["block", "ids", "sizes", "terms", "impacts", "top_terms", "tops"])

    blocks = forward.filter(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("block"), "ids", "lengths", "sizes", "terms", "counts")
    return blocks.mapInArrow(run, _INDEX)


def _bounds(top_terms: list[np.ndarray], tops: list[np.ndarray], queries: Queries, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Of each query in turn its bound on every block."""
    table = np.zeros((len(weights), len(tops)), np.int64)
    for i, (terms, values) in enumerate(zip(top_terms, tops, strict=True)):
        table[terms, i] = values
    table *= weights[:, None]
    for terms in queries.of:
        yield table[terms].sum(axis=0)


def _scores(sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scores of a block's documents; ``weights`` are 0 beside the query's terms."""
    return np.add.reduceat(weights[terms] * impacts, np.cumsum(sizes) - sizes)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _ragged(keys: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Each key with the numbers of its pair of arrays."""
    columns = np.repeat(keys, [len(p[0]) for p in pairs]), *(np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _seeds(index: DataFrame, sent, width: int) -> DataFrame:
    """(query, bound, block): the blocks of largest bound of each query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.of]
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            blocks = batch.column(0).to_numpy()
            for q, bound in enumerate(_bounds(_arrays(batch, "top_terms"), _arrays(batch, "tops"), queries, weights)):
                best[q] = _best(np.concatenate([best[q][0], blocks]), np.concatenate([best[q][1], bound]), NAMED)
        yield _ragged(np.arange(len(best)), best, ["query", "block", "bound"])

    rows = max(1, CELLS // width)
    return index.select("block", "top_terms", "tops").mapInArrow(run, "query long, block long, bound long").filter("bound > 0")


def _search(index: DataFrame, sent, width: int, k: int) -> DataFrame:
    """(query, doc, score): the k best of each query in each task, by falling bound, from the thresholds given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, least, only = sent.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.of]
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            blocks = batch.column(0).to_numpy()
            columns = [_arrays(batch, c) for c in ("ids", "sizes", "terms", "impacts")]
            for q, bound in enumerate(_bounds(_arrays(batch, "top_terms"), _arrays(batch, "tops"), queries, weights)):
                own = np.zeros_like(weights)
                own[queries.of[q]] = weights[queries.of[q]]
                for i in np.argsort(-bound, kind="stable"):
                    threshold = max(least[q], found[q][1][-1] if len(found[q][1]) == k else 0, 1)
                    if bound[i] < threshold:
                        break
                    if only is not None and (q, blocks[i]) not in only:
                        continue
                    ids_here, *lists = (c[i] for c in columns)
                    scores = _scores(*lists, own)
                    good = np.flatnonzero(scores >= threshold)
                    if len(good):
                        ids, old = found[q]
                        found[q] = _best(np.concatenate([ids, ids_here[good]]), np.concatenate([old, scores[good]]), k)
        yield _ragged(queries.rows, found, ["query", "doc", "score"])

    rows = max(1, CELLS // width)
    return index.mapInArrow(run, "query long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _search_part(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str, block_docs: int) -> DataFrame | None:
    """(query, doc, score, rank) of some queries; None if nothing can be found."""
    spark, width = docs.sparkSession, len(queries.terms)
    if not width:
        return None
    forward = durable(forward_index(docs, queries.terms, id_col, text_col, block_docs))
    n_docs, n_words = forward.agg(F.sum("docs"), F.sum("words")).first()
    if not n_docs:
        return None
    df = _document_counts(forward, width)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    index = durable(block_index(forward, n_docs, n_words))

    named = _seeds(index, spark.sparkContext.broadcast((queries, weights)), width)
    over = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    seeds = {(r[0], r[1]) for r in named.withColumn("n", F.row_number().over(over)).filter(F.col("n") <= SEEDS).select("query", "block").collect()}
    least = np.zeros(len(queries.of), np.int64)
    first = index.filter(F.col("block").isin(sorted({b for _, b in seeds})))
    scored = _search(first, spark.sparkContext.broadcast((queries, weights, least, seeds)), width, k)
    for q, score in _ranked(scored, k).filter(F.col("rank") == k).select("query", "score").collect():
        least[np.searchsorted(queries.rows, q)] = score
    return _ranked(_search(index, spark.sparkContext.broadcast((queries, weights, least, None)), width, k), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", block_docs: int = BLOCK_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(``item_id_col``, rank, ``id_col``, score): the ``k`` best documents of every row of ``items``."""
    rows = durable(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_id_col).alias("_name"), F.encode(text_or_empty(item_text_col), "UTF-8").alias("text")))
    parts = parts_within(rows, ["query"], F.length("text").cast("long") + 100, max_bytes)
    out = docs.sparkSession.createDataFrame([], "query long, doc long, score long, rank int")
    for part in range(parts):
        mine = gather(rows.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).orderBy("query").select("query", "text"))
        found = _search_part(docs, mine, k, id_col, text_col, block_docs)
        out = out if found is None else found if parts == 1 else out.unionByName(durable(found))
    named = out.join(rows.select("query", "_name"), "query")
    return named.select(F.col("_name").alias(item_id_col), "rank", F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(id_col), "score")
