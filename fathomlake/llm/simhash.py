"""SimHash near-duplicates by a byte-position inverted index.

A 64-bit fingerprint is eight bytes in eight positions.  Two fingerprints that
differ in at most ``max_bits`` = 4 bits share at least four of the eight
positional bytes: that is the count filter.  A list for every single byte
would hold 1/256 of all fingerprints, so the index keys are combinations of
three positions, chosen so that *every* set of four positions holds one of the
20 combinations: a pair that reaches the guaranteed count always meets in the
index.  Of pairs that meet, the shared positional bytes are tallied, pairs with
fewer than four are dropped, and the rest verified by the differing bits.

Exact copies share a fingerprint and are one entry of the index.  A list with
more than ``block`` entries is cut into blocks and each pair of blocks is a unit
of work of its own, so every pair is still compared and no list is one task.  A
unit returns a spanning forest of its links, not the pairs: components are
what is asked for, and they stay the same.

A node of the graph is a fingerprint together with the first of its rows, and
nodes are ordered by that row: the root of a component then carries the
component's first row, and nothing has to be gathered by component.

Null texts count as empty; texts with no word have fingerprint zero and link
like any other.  Ids may repeat; null ids form no component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, durable, join_spread, text_or_empty, total_parts
from .components import connected_components

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
BLOCK = 4096


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The text's SimHash; over half of the shingle hashes decide each bit."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    if len(words) <= size:
        starts, stops = [0], [len(joined)]
    else:
        starts = [0, *(ends[: -size] + 1).tolist()]
        stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) for every row; fp is the fingerprint as a signed bigint, h a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["id", "h", "fp"])

    text = text_or_empty(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(
        run, "id bigint, h bigint, fp bigint"
    )


def position_sets(bytes_total: int = 8, width: int = 3) -> list[tuple[int, ...]]:
    """Combinations of ``width`` positions; every ``width + 1`` positions hold one.

    Positions are dealt to three classes; kept are the combinations inside a
    class and those of two positions of a class with one of the next.
    """
    classes = [i % 3 for i in range(bytes_total)]

    def keep(c: tuple[int, ...]) -> bool:
        k = sorted(classes[i] for i in c)
        if k[0] == k[2]:
            return True
        twice = next((x for x in set(k) if k.count(x) == 2), None)
        return twice is not None and k.count((twice + 1) % 3) == 1

    return [c for c in combinations(range(bytes_total), width) if keep(c)]


def _masks() -> list[int]:
    masks = [sum(0xFF << (8 * i) for i in c) for c in position_sets()]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def forest(values: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct ``values``."""
    left, edges = values.view(np.uint64).copy(), []
    enough = 8 - max_bits
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            parent = np.zeros(len(left), np.uint64)
            step = max(1, 1_000_000 // len(left))
            for at in range(0, len(front), step):
                some = front[at : at + step]
                apart = some[:, None] ^ left[None, :]
                shared = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
                near = (shared >= enough) & (np.bitwise_count(apart) <= max_bits)
                hit = near.any(axis=0) & ~found
                parent[hit] = some[near.argmax(axis=0)[hit]]
                found |= hit
            edges += zip(left[found].view(np.int64).tolist(), parent[found].view(np.int64).tolist(), strict=True)
            front, left = left[found], left[~found]
    return edges


#: A fingerprint and its first row; rows without an id come last.
NODE = "struct<none:int,id:bigint,h:bigint,fp:bigint>"
PARTS = ["none", "id", "h", "fp"]


def _unit_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by unit; a unit may go on in the next frame."""
    held: list[pd.DataFrame] = []

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        unit, fp = frame["unit"].to_numpy(), frame["fp"].to_numpy(np.int64)
        rows = frame[PARTS].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        edges: dict[tuple[int, int], tuple] = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                values, at = np.unique(fp[a:b], return_index=True)
                for u, v in forest(values):
                    i, j = np.searchsorted(values, [u, v])
                    edges[u, v] = (*rows[a + at[i]].tolist(), *rows[a + at[j]].tolist())
        return pd.DataFrame(list(edges.values()), columns=[f"{side}_{p}" for side in "uv" for p in PARTS], dtype="int64")

    for frame in frames:
        if frame.empty:
            continue
        last = frame["unit"].iat[-1]
        if held and held[0]["unit"].iat[0] == last:
            held.append(frame)
            continue
        same = frame["unit"] == last
        yield work(pd.concat([*held, frame[~same]]))
        held = [frame[same]]
    if held:
        yield work(pd.concat(held))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all ``nodes`` (column node) within ``max_bits`` bits.

    Every fingerprint is in one node.
    """
    if max_bits > 4:
        raise ValueError("the index guarantees a meeting up to 4 differing bits")
    keys = F.array(*[F.struct(F.lit(i).alias("set"), F.col("node.fp").bitwiseAND(F.lit(m)).alias("bytes"))
                     for i, m in enumerate(_masks())])
    index = nodes.select("node", F.explode(keys).alias("k")).select("node", F.xxhash64("k.set", "k.bytes").alias("key"))
    lists = durable(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = join_spread(index, lists, ["key"], "node").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node.fp", F.lit(1)), F.col("blocks")).cast("int")
    units = met.select("node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    dealt = units.select("node.*", unit).repartition(total_parts(nodes), "unit").sortWithinPartitions("unit")
    made = dealt.mapInPandas(_unit_edges, ", ".join(f"{side}_{p} bigint" for side in "uv" for p in PARTS))

    def node(side: str) -> Column:
        return F.struct(*[F.col(f"{side}_{p}").cast("int" if p == "none" else "long").alias(p) for p in PARTS]).cast(NODE).alias(side)

    return made.select(node("u"), node("v"))


def _placed(own: DataFrame) -> DataFrame:
    """(node, root) of every fingerprint of ``own`` (id, h, fp)."""
    first = F.min(F.struct(F.col("id").isNull().cast("int").alias("none"), F.coalesce("id", F.lit(NULL_ID)).alias("id"), "h"))
    nodes = durable(own.groupBy("fp").agg(first.alias("f")).select(F.struct("f.none", "f.id", "f.h", "fp").cast(NODE).alias("node")))
    roots = connected_components(links(nodes))
    return durable(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row.

    ``component_id`` is the smallest id reachable over links of at most four
    differing bits, the row's own included.
    """
    own = durable(fingerprints(df, id_col, text_col))
    named = _placed(own).select("node.fp", F.when(F.col("root.none") == 0, F.col("root.id")).alias("component_id"))
    return join_spread(own, named, ["fp"], "id").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with the smallest (id, text hash).

    Null ids come last, so a row without one stays only if its component has no
    other id.  Rows equal in id and text are one component's; of them one stays.
    """
    own = durable(fingerprints(df, id_col, text_col))
    kept = _placed(own).filter("node = root").select(
        F.col("node.none").alias("_none"), F.col("node.id").alias("_id"), F.col("node.h").alias("_h"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    key = F.col(id_col).cast("long")
    given = df.select(row.alias("_row"), key.isNull().cast("int").alias("_none"), F.coalesce(key, F.lit(NULL_ID)).alias("_id"),
                      F.xxhash64(text_or_empty(text_col)).alias("_h"))
    # Equal rows fall together before the shuffle, and the join uses the same dealing.
    once = given.groupBy("_none", "_id", "_h").agg(F.first("_row").alias("_row"))
    return once.join(kept, ["_none", "_id", "_h"], "left_semi").select("_row.*")
