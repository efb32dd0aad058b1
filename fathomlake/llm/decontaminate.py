"""Finding and removing passages of benchmark items in training documents.

The distinct windows of the items (``size`` consecutive words; an item of fewer
words is one window) are broadcast as a set of hashes with their words.  The
windows of every document are hashed and looked up; every hit is compared word
by word.  Documents are neither shuffled nor grouped, so no key is hot.

The set's bytes are summed before anything is gathered.  Beyond ``max_bytes``
the windows are dealt by hash into parts that keep the bound, and the documents
are read once a part, each pass adding its hits to those of the passes before.

Defined results.  A null text has no words, as an empty one.  An item without
words finds nothing; items with one id are one item; an item with a null id
marks words but is not listed.  Repeated documents give repeated rows, also
where the id is null.  Empty tables give empty results or no hits.  Other
columns of either table are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import byte_words
from .common import ascii_lower, durable, parts_within, split_words, text_or_empty
from .license_scan import SEPARATORS

WINDOW = 10
#: Windows with their words and item lists that one broadcast set may hold.
MAX_BYTES = 32 << 20

_SPANS = "array<struct<first_word:long,last_word:long,start:long,end:long>>"


@dataclass(frozen=True)
class WindowSet:
    """Windows as hashes, their words, and the list of items that each stands in."""

    by_size: dict[int, tuple[byte_words.HashSet, np.ndarray]]  # and the window of each hash
    words: list[bytes]
    lists: list[tuple[str, ...]]
    list_of: np.ndarray


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, ids): every distinct window, its words joined by spaces, and its items."""
    given = items.select(F.col(id_col).cast("string").alias("id"), split_words(ascii_lower(text_or_empty(text_col)), SEPARATORS).alias("ws"))
    n = F.size("ws")
    whole = F.array(F.array_join("ws", " "))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.array_join(F.slice("ws", i + 1, size), " "))
    rows = given.filter(n > 0).select("id", F.explode(F.when(n <= size, whole).otherwise(cut)).alias("window"))
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def gather(windows: DataFrame) -> WindowSet:
    """The set of some windows, on the driver; the caller has checked their size."""
    rows = windows.select(F.encode("window", "UTF-8"), "ids").collect()
    words = [bytes(r[0]) for r in rows]
    places: dict[tuple[str, ...], int] = {}
    list_of = np.array([places.setdefault(tuple(r[1]), len(places)) for r in rows], np.int64)
    own = byte_words.read(words)
    counts = np.bincount(own.row, minlength=len(words))
    firsts = np.cumsum(counts) - counts
    by_size = {}
    for size in np.unique(counts):
        of = np.flatnonzero(counts == size)
        hashes = byte_words.windows(own.keys, int(size))[firsts[of]]
        by_size[int(size)] = (byte_words.HashSet(hashes), of[np.argsort(hashes, kind="stable")])
    return WindowSet(by_size, words, list(places), list_of)


def _hits(words: byte_words.Words, windows: WindowSet, rows: int) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are inside an occurrence of a window, and each text's item lists."""
    edges, lists = np.zeros(len(words.keys) + 1, np.int64), [set() for _ in range(rows)]
    for size, (found, of) in windows.by_size.items():
        hashes = byte_words.windows(words.keys, size)
        for i, place in zip(*found.find(hashes), strict=True):
            if words.row[i] != words.row[i + size - 1]:
                continue  # the window runs from one text into the next
            here = words.data[words.starts[i] : words.ends[i + size - 1]].tobytes()
            while place < len(of) and found.hashes[place] == hashes[i]:
                if windows.words[of[place]] == here:
                    edges[i] += 1
                    edges[i + size] -= 1
                    lists[words.row[i]].add(int(windows.list_of[of[place]]))
                place += 1
    return np.cumsum(edges[:-1]) > 0, lists


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2], edges[1::2], strict=True))


def _scan(docs: DataFrame, windows: WindowSet, carry: bool) -> DataFrame:
    """The hits of one set added to those that the rows bring; with ``carry`` the text stays."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    schema = docs.schema

    def one(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, before: list[dict]) -> list[dict]:
        for s in before:
            hit[s["first_word"] : s["last_word"] + 1] = True
        out = []
        for first, end in _runs(hit):
            start = len(text[: starts[first]].decode("utf-8", "replace"))
            length = len(text[starts[first] : ends[end - 1]].decode("utf-8", "replace"))
            out.append({"first_word": int(first), "last_word": int(end - 1), "start": start, "end": start + length})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = sent.value, {}
        for batch in batches:
            at = 0
            for texts in byte_words.slices(v.as_py() for v in batch.column(1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                words = byte_words.read(texts)
                hit, lists = _hits(words, held, len(texts))
                counts = np.bincount(words.row, minlength=len(texts))
                cuts = np.cumsum(counts) - counts
                spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                for i, text in enumerate(texts):
                    own = slice(cuts[i], cuts[i] + counts[i])
                    if lists[i]:
                        spans[i] = one(text, words.raw_starts[own], words.raw_ends[own], hit[own].copy(), spans[i])
                        key = frozenset(lists[i])
                        if key not in names:
                            if len(names) > 1000:
                                names.clear()
                            names[key] = frozenset().union(*(held.lists[j] for j in key))
                        items[i] = sorted(names[key].union(items[i]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1) if carry else pa.nulls(len(texts), pa.binary()), pa.array(counts, pa.int64()),
                     pa.array(spans, part.column(3).type), pa.array(items, pa.list_(pa.string()))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
         max_bytes: int = MAX_BYTES, with_text: bool = False) -> DataFrame:
    """One row a document: ``id_col``, n_words, n_hit, spans, items (and ``text_col``).

    ``spans`` are the longest runs of hit words: first and last word from 0, start
    and end (exclusive) in code points.  ``items`` are the ids of the items that
    have an occurring window, as strings in ascending order.
    """
    found = durable(item_windows(items, size=size))
    weight = F.octet_length("window").cast("long") + 100 + 40 * F.size("ids")
    parts = parts_within(found, ["window"], weight, max_bytes)
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("_text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        last = part == parts - 1
        rows = _scan(rows, gather(found.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)), with_text or not last)
        rows = rows if last else durable(rows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last_word"] - x["first_word"] + 1)
    text = [F.decode("_text", "UTF-8").alias(text_col)] if with_text else []
    return rows.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items", *text)


def _without(text: Column, spans: Column) -> Column:
    """``text`` less its spans (ascending, apart), what lies between them as it was."""
    n = F.size(spans)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: text.substr((F.get(starts, i) + 1).cast("int"), (F.get(ends, i) - F.get(starts, i)).cast("int")))
    return F.when(n == 0, text).otherwise(F.array_join(pieces, ""))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text",
                  size: int = WINDOW, max_share: float = 0.0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(``id_col``, ``text_col``) without the passages of benchmark items.

    ``remove="spans"`` cuts the hit words, from the first to the last of a run,
    out of each text.  ``remove="documents"`` drops documents whose hit words are
    over ``max_share`` of their words and leaves the others as they are.
    """
    marked = mark(docs, items, id_col, text_col, size, max_bytes, with_text=True)
    if remove == "documents":
        return marked.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words")).select(id_col, text_col)
    if remove != "spans":
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    return marked.select(id_col, _without(F.col(text_col), F.col("spans")).alias(text_col))
