"""Passages that documents share, exactly or nearly, by collinear chaining.

1. Texts.  Equal texts are one text, held by several documents; a text of at
   least ``min_words`` words with two holders is a passage as a whole.  One of its
   holders goes on, for the sake of the other texts.
2. Seeds.  Words are runs of non-space characters, A-Z lowered.  Of the hashed
   runs of ``K`` = 4 words those with a hash in the lowest ``1 / RATE`` are seeds,
   whatever stands around them, and of each window of ``WINDOW`` = 20 runs without
   one the smallest.  So a run that both texts hold is a seed of both or of none
   but for those windows, and any two copies of 23 words hold a common seed at the
   same place, of 43 words two.
3. Matches, first round.  Seeds that occur in two or more texts are joined to
   their first and to their last text, in the order of the texts' hashes.  That
   is two matches an occurrence, so a passage in a third of all documents costs
   as little per document as one in two.
4. Chains.  The matches of a text with one partner, ordered in both, are
   chained: a Fenwick tree over the partner's places gives the best earlier
   match under a cost for gaps.  A chain is cut at gaps over ``MAX_GAP`` words;
   it has two matches or more.
5. Alignment.  A chain's stretch is widened by ``WIDEN`` words on both sides and
   the two word sequences are aligned: common runs of three words are put in order
   by a longest increasing sequence and extended.  Where at least
   ``MIN_IDENTITY`` of its words are equal and in order the whole of it is a
   passage, else every longest run of equal parts that reaches it.  A passage
   has at least ``min_words`` words.
6. Matches, second round.  Seeds of a text that no passage of the first round
   covers, if they and the seeds near them can make a passage, are joined to
   *every* other text that holds them, so that no text hides another, and
   chained and aligned again.  That is done for seeds with up to ``HELD`` = 8
   occurrences; seeds with more are joined in pairs with the seeds that follow or
   precede them within ``PAIR`` = 60 words, all of them, as a chain would join them; pairs
   with up to ``HELD`` occurrences again to every other text, and pairs with more
   to their first and last text, which hold both ends of that stretch too.
7. Matches, third round.  Pairs with more than ``HELD`` occurrences that are still
   not covered are joined to every other text that can make a passage with theirs:
   none is dropped but by a bound that holds for all alignments.  All equal words of
   an alignment lie in common runs of three words.  Runs that up to ``HELD`` texts
   have around such pairs are rare, the others frequent.  Texts with a common rare
   run are partners if in both a passage is possible around one of these runs, all
   equal words of which their common rare runs and the frequent ones cover.  Passages of frequent runs alone: of each stretch that
   these could fill, the rarest are its probes, as few as leave no passage of two
   different runs possible without them.  The rarest run of a passage is a probe of
   both texts, so partners are those with a common probe.  A passage of one run
   alone is a word (or two or three) said again and again; as a stretch without
   other words it is as long as with the longest other such stretch, which is
   its partner (an alignment skips no words inside such a stretch), and the few with other words between meet all of their run.
8. The passages of a document that overlap or touch are merged.

Whole texts are read.  Null and short texts have no passages.  Rows with one id
and text count once; different texts of one id are read apart and are no
partners of each other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, durable, join_buckets, join_spread, text_or_empty, total_parts

K = 4
RATE = 10
WINDOW = 20
WIDEN = 50
MAX_GAP = 60
MIN_IDENTITY = 0.8
GAP_COST = 0.02
MIN_WORDS = 50
HELD = 8
PAIR = MAX_GAP
PASSAGE = "t bigint, doc bigint, start int, end int, partner bigint, p_doc bigint, p_start int, p_end int, identity double"


def word_codes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh32_intdigest
    return np.fromiter(map(digest, words), np.uint32, len(words))


def seeds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) of the runs of K words with a low hash, and of the smallest of each window without one."""
    n, codes = len(codes) - K + 1, codes.astype(np.uint64)
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for i in range(K):
        run = run * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        run ^= run >> np.uint64(shift)
        run *= np.uint64(factor)
    run ^= run >> np.uint64(32)
    width = min(WINDOW, n)
    low = run < np.uint64(2**64 // RATE)
    before = np.concatenate([[0], np.cumsum(low)])
    bare = np.flatnonzero(before[width:] == before[:-width])  # where a window without a low run starts
    view = np.lib.stride_tricks.sliding_window_view(run, width)
    at = [view[bare[a : a + 50_000]].argmin(axis=1) + bare[a : a + 50_000] for a in range(0, len(bare), 50_000)]
    at.append(np.flatnonzero(low))
    picks = np.unique(np.concatenate(at))
    found = run[picks]
    # Where one run comes again and again, one pick a window is enough; the
    # number of its window joins the seed, so that such stretches align too.
    fresh = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    nth = (picks - np.repeat(picks[fresh], np.diff(fresh, append=len(found)))) // width
    found = found + nth.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    keep = np.concatenate([[True], found[1:] != found[:-1]])
    return picks[keep], found[keep]


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts (t, doc, n, codes), and (t, doc) of each holder of a text that has two.

    ``t`` is the text's hash, ``doc`` its smallest holder and codes its words.
    The texts are in buckets of ``t``.
    """
    given = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    given = given.withColumn("t", F.xxhash64("text"))
    holders = durable(given.groupBy("t").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("_n")))
    total, sizes = df.count(), holders.select("t", "_n")
    # copies meet where they are read, so a text moves once
    chosen = given.groupBy("t").agg(F.min(F.struct("doc", "text")).alias("a")).select("t", "a.doc", "a.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes = [word_codes(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(c) for c in codes], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["t", "doc", "n", "codes"])

    texts = bucketed(chosen.mapInArrow(run, "t bigint, doc bigint, n int, codes binary"), "t")
    twice = holders.filter("lo <> hi").select("t", "lo", "hi")
    copies = join_spread(given.select("t", "doc").distinct(), twice, ["t"], "doc", sizes, total)
    return texts, copies


def seed_rows(texts: DataFrame) -> DataFrame:
    """(t, place, seed) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [seeds(np.frombuffer(c.as_py(), np.uint32)) for c in part.column(1)]
                t = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(p) for p, _ in found])
                place = np.concatenate([p for p, _ in found]).astype(np.int32)
                seed = np.concatenate([s for _, s in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(place), pa.array(seed)], names=["t", "place", "seed"])

    return texts.filter(F.col("n") >= K).select("t", "codes").mapInArrow(run, "t bigint, place int, seed bigint")


def best_chain(x: np.ndarray, y: np.ndarray, gap_cost: float = GAP_COST) -> list[int]:
    """Indices of the best chain of matches, increasing in x and in y.

    Matches are sorted by x.  The cost of a step is ``gap_cost`` times the words
    passed over in both texts; it splits into a part for each end, so the best
    predecessor is a prefix maximum over y, which a Fenwick tree holds.
    """
    n = len(x)
    if n < 2 or (np.all(np.diff(x) > 0) and np.all(np.diff(y) > 0)):
        return list(range(n))
    rank = np.searchsorted(np.unique(y), y) + 1
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (int(rank.max()) + 1)
    score, before = [0.0] * n, [-1] * n
    xs, ys, ranks = x.tolist(), y.tolist(), rank.tolist()
    start = 0
    while start < n:
        stop = start
        while stop < n and xs[stop] == xs[start]:
            stop += 1
        for j in range(start, stop):  # matches at one place don't follow each other
            best, at, i = -np.inf, -1, ranks[j] - 1
            while i > 0:
                if tree[i][0] > best:
                    best, at = tree[i]
                i -= i & -i
            gain = best - gap_cost * (xs[j] + ys[j])
            score[j], before[j] = (K + gain, at) if at >= 0 and gain > 0 else (float(K), -1)
        for j in range(start, stop):
            value, i = score[j] + gap_cost * (xs[j] + ys[j]), ranks[j]
            while i < len(tree):
                if value > tree[i][0]:
                    tree[i] = (value, j)
                i += i & -i
        start = stop
    j, chain = int(np.argmax(score)), []
    while j >= 0:
        chain.append(j)
        j = before[j]
    return chain[::-1]


def _chains(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x0, x1, y0, y1) of the stretches of all chains of one document pair.

    The best chain is taken off, and the next is sought in what it leaves.
    """
    out, left = [], np.arange(len(x))
    while len(left):
        chain = left[best_chain(x[left], y[left])]
        cx, cy = x[chain], y[chain]
        cut = np.flatnonzero((np.diff(cx) > MAX_GAP) | (np.diff(cy) > MAX_GAP)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(chain)], strict=True):
            out.append((int(cx[a]), int(cx[b - 1]) + K, int(cy[a]), int(cy[b - 1]) + K))
        # A copy has a pick in every window; wider gaps may hold words of another place.
        covered = np.zeros(len(left), bool)
        wide = np.flatnonzero((np.diff(cx) > WINDOW) | (np.diff(cy) > WINDOW)) + 1
        for a, b in zip([0, *wide.tolist()], [*wide.tolist(), len(chain)], strict=True):
            covered |= (x[left] >= cx[a]) & (x[left] < cx[b - 1] + K)
        covered |= np.isin(left, chain)
        left = left[~covered]
    return out


def _by_key(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end where ``key`` changes, from frames sorted by it."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[key].iloc[-1]
        same = (frame[key] == last).all(axis=1).to_numpy()
        if same.all() and held and (held[0][key].iloc[0] == last).all():
            held.append(frame)
            continue
        done = [*held, frame[~same]] if not same.all() else held
        if done:
            yield pd.concat(done, ignore_index=True)
        held = [frame[same]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _groups(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of the stretches over which all keys stay the same."""
    if len(keys[0]):
        turn = np.zeros(len(keys[0]) - 1, bool)
        for k in keys:
            turn |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), len(keys[0])]
        yield from zip(cuts, cuts[1:], strict=False)


def _chain_frames(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_key(frames, ["t", "partner"]):
            t, partner = frame["t"].to_numpy(), frame["partner"].to_numpy()
            x, y, fresh = frame["place"].to_numpy(np.int64), frame["other"].to_numpy(np.int64), frame["open"].to_numpy(bool)
            rows = [
                (t[a], partner[a], *c)
                for a, b in _groups(t, partner) if b - a > 1 and fresh[a:b].any()
                for c in _chains(x[a:b], y[a:b])
                if min(c[1] - c[0], c[3] - c[2]) > K and (fresh[a:b] & (x[a:b] >= c[0]) & (x[a:b] < c[1])).any()
            ]
            yield pd.DataFrame(rows, columns=["t", "partner", "x0", "x1", "y0", "y1"])

    return run


def _grams(codes: np.ndarray) -> np.ndarray:
    """Runs of three words, each told apart by its number among equal ones."""
    c = codes.astype(np.uint64)
    run = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + c[2:]
    order = np.argsort(run, kind="stable")
    kept = run[order]
    fresh = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]]))
    nth = np.arange(len(run)) - np.repeat(fresh, np.diff(fresh, append=len(run)))
    run[order] = kept + nth.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return run


def _increasing(y: np.ndarray) -> np.ndarray:
    """Places of a longest increasing sequence of ``y``."""
    if len(y) < 2 or np.all(np.diff(y) > 0):
        return np.arange(len(y))
    tails, last, before = [], [], []
    for i, v in enumerate(y.tolist()):
        at = bisect_left(tails, v)
        before.append(last[at - 1] if at else -1)
        tails[at:] = [v, *tails[at + 1 :]] if at < len(tails) else [v]
        last[at:] = [i, *last[at + 1 :]] if at < len(last) else [i]
    i, out = last[-1], []
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from the start are equal."""
    n = min(len(a), len(b))
    for size in (min(16, n), n):
        apart = np.flatnonzero(a[:size] != b[:size]) if n else []
        if len(apart):
            return int(apart[0])
    return n


def equal_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of equal blocks, in order in both."""
    if min(len(a), len(b)) < 3:
        return []
    _, i, j = np.intersect1d(_grams(a), _grams(b), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    kept = _increasing(j)
    i, j = i[kept], j[kept]
    if not len(i):
        return []
    cut = np.flatnonzero((np.diff(i) > 3) | (np.diff(i) != np.diff(j))) + 1
    out: list[tuple[int, int, int]] = []
    end_a = end_b = 0
    starts, stops = [0, *cut.tolist()], [*cut.tolist(), len(i)]
    for k, (s, e) in enumerate(zip(starts, stops, strict=True)):
        x, y, stop = int(i[s]), int(j[s]), int(i[e - 1]) + 3
        skip = max(0, end_a - x, end_b - y)  # the block before may have grown over it
        x, y = x + skip, y + skip
        if x >= stop:
            continue
        back = _equal_run(a[end_a:x][::-1], b[end_b:y][::-1])
        x, y = x - back, y - back
        next_a, next_b = (int(i[starts[k + 1]]), int(j[starts[k + 1]])) if k + 1 < len(starts) else (len(a), len(b))
        size = stop - x
        size += _equal_run(a[x + size : max(next_a, x + size)], b[y + size : max(next_b, y + size)])
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((x, y, size))
        end_a, end_b = x + size, y + size
    return out


def _segments(blocks: list) -> list[tuple[int, int, int, int, int]]:
    """Of equal blocks in order, all of them or the longest runs that qualify."""
    a, b, size = (np.array([m[i] for m in blocks], np.int64) for i in range(3))
    total, out, last = np.concatenate([[0], np.cumsum(size)]), [], -1
    for i in range(len(blocks)):
        same = total[i + 1 :] - total[i]
        fine = np.flatnonzero(same >= MIN_IDENTITY * np.maximum(a[i:] + size[i:] - a[i], b[i:] + size[i:] - b[i]))
        j = i + int(fine[-1])
        if j > last:  # no part of the run before
            last = j
            if total[j + 1] - total[i] >= K:
                out.append((int(a[i]), int(a[j] + size[j]), int(b[i]), int(b[j] + size[j]), int(total[j + 1] - total[i])))
        if last == len(blocks) - 1:
            break
    return out


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in a, (start, end) in b and equal words of each passage."""
    blocks = [m for m in equal_blocks(a, b) if m[2] >= 3]
    return _segments(blocks) if blocks else []


def _alignable(chain: np.ndarray, side: np.ndarray, codes: np.ndarray, min_words: int) -> Iterator[bool]:
    """Of each chain, if its two sides have as many runs of three words in common as the equal words of a passage hold.

    Equal words come in blocks of three or more, so a third of them or more begin a common run.
    """
    fresh = np.concatenate([[True], chain[1:] != chain[:-1]]) if len(chain) else np.empty(0, bool)
    number = np.cumsum(fresh) - 1
    size = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
    piece = np.cumsum(size) // 500_000  # in pieces that end where a chain does
    piece = piece[np.flatnonzero(fresh)][number] if len(chain) else piece
    for a, b in _groups(piece):
        c = np.frombuffer(b"".join(codes[a:b]), np.uint32).astype(np.uint64)
        n = number[b - 1] - number[a] + 1
        if len(c) < 3:
            yield from [False] * int(n)
            continue
        row = np.repeat(np.arange(a, b), size[a:b])
        run = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + c[2:]
        inside, of = row[:-2] == row[2:], (number[row] - number[a])[:-2]
        run = (run + of.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        run ^= of.astype(np.uint64) << np.uint64(40)
        mine, theirs = inside & (side[row[:-2]] == 0), inside & (side[row[:-2]] != 0)
        met = np.isin(run[mine], run[theirs])
        yield from (3 * np.bincount(of[mine][met], minlength=n) >= _least(min_words)).tolist()


def _aligned(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_key(frames, ["chain"]):
            chain, side = frame["chain"].to_numpy(), frame["side"].to_numpy()
            t, doc, begin, codes = (frame[c].to_numpy() for c in ("t", "doc", "begin", "codes"))
            rows = []
            for (i, stop), able in zip(_groups(chain), _alignable(chain, side, codes, min_words), strict=True):
                if not able:
                    continue
                j = i + int(np.searchsorted(side[i:stop], 1))  # sorted by side: i is the finder's row, j the partner's
                if side[i] or j == stop or doc[i] == doc[j]:
                    continue
                for a0, a1, b0, b1, same in _align(np.frombuffer(codes[i], np.uint32), np.frombuffer(codes[j], np.uint32)):
                    if max(a1 - a0, b1 - b0) >= min_words:
                        rows.append((t[i], doc[i], begin[i] + a0, begin[i] + a1, t[j], doc[j], begin[j] + b0, begin[j] + b1, same / max(a1 - a0, b1 - b0)))
            yield pd.DataFrame(rows, columns=["t", "doc", "start", "end", "partner", "p_doc", "p_start", "p_end", "identity"])

    return run


def passages(matches: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """Chains of ``matches`` (t, place, partner, other, open), aligned: the PASSAGE columns.

    A chain has a match that is ``open``.
    """
    parts = total_parts(texts)
    dealt = matches.repartition(parts, "t", "partner").sortWithinPartitions("t", "partner", "place", "other")
    chains = durable(
        dealt.mapInPandas(_chain_frames(min_words), "t bigint, partner bigint, x0 int, x1 int, y0 int, y1 int")
        .withColumn("chain", F.xxhash64("t", "partner", "x0", "x1", "y0", "y1")).dropDuplicates(["chain"])
    )

    def side(number: int, t: str, a: str, b: str) -> DataFrame:
        return chains.select("chain", F.lit(number).alias("side"), F.col(t).alias("t"),
                             F.greatest(F.lit(0), F.col(a) - WIDEN).alias("begin"), (F.col(b) + WIDEN).alias("stop"))

    asked = side(0, "t", "x0", "x1").unionByName(side(1, "partner", "y0", "y1"))
    cut = F.substring("codes", F.col("begin") * 4 + 1, (F.col("stop") - F.col("begin")) * 4)
    stretches = join_buckets(asked, texts.select("t", "doc", "codes"), "t", "chain").select("chain", "side", "t", "doc", "begin", cut.alias("codes"))
    return durable(stretches.repartition(parts, "chain").sortWithinPartitions("chain", "side").mapInPandas(_aligned(min_words), PASSAGE))


def both_sides(found: DataFrame) -> DataFrame:
    """t, doc, start, end, partner (a document), identity: of finders and partners."""
    return found.select("t", "doc", "start", "end", F.col("p_doc").alias("partner"), "identity").unionByName(
        found.select(F.col("partner").alias("t"), F.col("p_doc").alias("doc"), F.col("p_start").alias("start"), F.col("p_end").alias("end"),
                     F.col("doc").alias("partner"), "identity"))


def _open(min_words: int):
    """Seeds that no passage covers, and those near them: frames of one text, passages first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_key(frames, ["t"]):
            t, kind, place, value = (frame[c].to_numpy() for c in ("t", "kind", "place", "value"))
            keep, fresh = np.zeros(len(frame), bool), np.zeros(len(frame), bool)
            for a, b in _groups(t):
                m = a + int(np.searchsorted(kind[a:b], 1))
                places = place[m:b].astype(np.int64)
                if not len(places):
                    continue
                bare = np.ones(len(places), bool)
                if m > a:  # the furthest end of the passages that begin before the seed does
                    at = np.searchsorted(place[a:m], places, side="right")
                    bare = (at == 0) | (np.maximum.accumulate(value[a:m])[np.maximum(at, 1) - 1] < places + K)
                known = places[bare]
                if not len(known):
                    continue
                spot = np.searchsorted(known, places)
                apart = np.minimum(np.abs(places - known[np.maximum(spot, 1) - 1]), np.abs(places - known[np.minimum(spot, len(known) - 1)]))
                near = np.flatnonzero(apart <= min_words)
                cut = np.flatnonzero(np.diff(places[near]) > MAX_GAP) + 1
                for run_ in np.split(near, cut):
                    if len(run_) > 1:
                        keep[m + run_] = True
                fresh[m:b] = bare
            yield frame.assign(open=fresh)[keep][["t", "place", "value", "n", "open"]].rename(columns={"value": "seed"})

    return run


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a text's seeds within PAIR words, one of them held often: t, key, place, then, open."""
    for frame in _by_key(frames, ["t"]):
        t, place = frame["t"].to_numpy(), frame["place"].to_numpy(np.int64)
        seed, often, fresh = frame["seed"].to_numpy().view(np.uint64), frame["n"].to_numpy() > HELD, frame["open"].to_numpy(bool)
        out, step = [], 1
        while step < len(frame):
            near = (t[step:] == t[:-step]) & (place[step:] - place[:-step] <= PAIR)
            if not near.any():
                break
            i = np.flatnonzero(near & (often[step:] | often[:-step]))
            key = (seed[i] * np.uint64(0x9E3779B97F4A7C15) + seed[i + step]) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(pd.DataFrame({"t": t[i], "key": key.view(np.int64), "place": place[i].astype(np.int32), "then": place[i + step].astype(np.int32),
                                     "open": fresh[i] | fresh[i + step]}))
            step += 1
        if out:
            yield pd.concat(out, ignore_index=True)


def _left_open(shared: DataFrame, found: DataFrame, parts: int, min_words: int) -> DataFrame:
    """The seeds (t, place, seed, n, open) that no passage of ``found`` covers, and those near them."""
    covered = both_sides(found).groupBy("t", "start").agg(F.max("end").alias("end"))
    rows = covered.select("t", F.lit(0).alias("kind"), F.col("start").alias("place"), F.col("end").cast("long").alias("value"), F.lit(0).cast("long").alias("n")).unionByName(
        shared.select("t", F.lit(1).alias("kind"), "place", F.col("seed").alias("value"), "n"))
    return durable(rows.repartition(parts, "t").sortWithinPartitions("t", "kind", "place").mapInPandas(
        _open(min_words), "t bigint, place int, seed bigint, n bigint, open boolean"))


def _dealt_pairs(df: DataFrame, parts: int) -> DataFrame:
    dealt = df.select("t", "place", "seed", "n", "open").repartition(parts, "t").sortWithinPartitions("t", "place")
    return durable(dealt.mapInPandas(_pairs, "t bigint, key bigint, place int, then int, open boolean"))


def _of_pairs(met: DataFrame) -> DataFrame:
    """The two matches of each pair that is met: of t, place, then, open, p (t, place, then)."""
    both = F.explode(F.array(F.struct(F.col("place"), F.col("p.place").alias("other")), F.struct(F.col("then").alias("place"), F.col("p.then").alias("other"))))
    return met.select("t", F.col("p.t").alias("partner"), "open", both.alias("m")).select("t", "m.place", "partner", "m.other", "open")


def second_matches(shared: DataFrame, found: DataFrame, parts: int, min_words: int) -> tuple[DataFrame, DataFrame | None]:
    """Matches of the seeds that no passage of ``found`` covers, with every other holder.

    Of pairs with more than ``HELD`` occurrences only those with the first and the
    last holder; all occurrences of such pairs (t, key, place, then) come second,
    None if there are none.
    """
    left = _left_open(shared, found, parts, min_words)
    few = F.col("n") <= HELD
    other = shared.filter(few).select("seed", F.col("t").alias("partner"), F.col("place").alias("other"))
    light = left.filter(few).join(other, "seed").filter("partner <> t").select("t", "place", "partner", "other", "open")
    if left.filter(~few).isEmpty():
        return light, None

    every = _dealt_pairs(shared.select("t", "place", "seed", "n", F.lit(False).alias("open")), parts)
    open_pairs = _dealt_pairs(left, parts).filter("open")
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *[f(F.struct("t", "place", "then")).alias(c) for f, c in ((F.min, "a"), (F.max, "b"))])
    keys = durable(keys.filter("a.t <> b.t"))
    small = every.join(keys.filter(F.col("_n") <= HELD).select("key"), "key").select("key", F.struct("t", "place", "then").alias("p"))
    ends = keys.filter(F.col("_n") > HELD).select("key", F.array("a", "b").alias("ps"))
    met = open_pairs.join(small, "key").select("t", "place", "then", "open", "p")
    large = join_spread(open_pairs, ends, ["key"], "t", keys.select("key", "_n")).select("t", "place", "then", "open", F.explode("ps").alias("p"))
    met = met.unionByName(large).filter("p.t <> t")
    matches = light.unionByName(_of_pairs(met)).groupBy("t", "place", "partner", "other").agg(F.max("open").alias("open"))
    return matches, every.join(keys.filter(F.col("_n") > HELD).select("key"), "key").select("t", "key", "place", "then")


def _run_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, place, run) of the three-word runs in the stretches around the pairs of each text: of t, open, spots, codes."""
    for batch in frames:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ts, opens, places, runs = [], [], [], []
            for t, is_open, spots, codes in zip(*(part.column(i) for i in range(4)), strict=True):
                c = np.frombuffer(codes.as_py(), np.uint32).astype(np.uint64)
                n, ends = len(c) - 2, spots.as_py()
                edge = np.zeros(len(c) + 1, np.int64)  # where the stretches that an alignment sees begin and end
                np.add.at(edge, np.maximum(np.array([s["place"] for s in ends]) - WIDEN, 0), 1)
                np.add.at(edge, np.minimum(np.array([s["then"] for s in ends]) + K + WIDEN - 2, n), -1)
                here = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                run = (c[here] * np.uint64(0x9E3779B97F4A7C15) + c[here + 1]) * np.uint64(0x9E3779B97F4A7C15) + c[here + 2]
                ts.append(np.full(len(here), t.as_py()))
                opens.append(np.full(len(here), is_open.as_py()))
                places.append(here.astype(np.int32))
                runs.append(run.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ts, opens, places, runs)], names=["t", "open", "place", "run"])


def _run_kinds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of runs in order, and of texts in each: (t, place, run, n, null, null) of the frequent ones, n is 1 where a text first
    holds it, (t, null, null, n, partner, places) of the rare ones that two texts hold, one of them open, n its places in t."""
    names = ["t", "open", "place", "run"]
    tail, known = pd.DataFrame(columns=names), None  # the rows of a run that may go on; the last text and run known to be frequent

    def kinds(frame: pd.DataFrame) -> pd.DataFrame:
        t, is_open, place, run = (frame[c].to_numpy() for c in names)
        fresh = np.concatenate([[True], run[1:] != run[:-1]])
        first = fresh | np.concatenate([[True], t[1:] != t[:-1]])
        number = np.cumsum(fresh) - 1
        often = (np.bincount(number, first) > HELD)[number]
        if known is not None:
            often |= run == known[1]
            first[0] &= (t[0], run[0]) != known
        out = [pd.DataFrame({"t": t[often], "place": pd.array(place[often], "Int32"), "run": pd.array(run[often], "Int64"), "n": first[often].astype(np.int32),
                             "partner": pd.array([None] * int(often.sum()), "Int64"), "places": None})]
        at = np.flatnonzero(first & ~often)
        times, none = np.diff(np.flatnonzero(first), append=len(run))[~often[first]], pd.array([None], "Int64")
        for step in range(1, HELD):
            i = np.flatnonzero(run[at[step:]] == run[at[:-step]])
            for a, b in ((i, i + step), (i + step, i)):
                seek = (is_open[at[a]] | is_open[at[b]]).astype(bool)
                a, b = a[seek], b[seek]
                places = pd.Series([place[i : i + n] for i, n in zip(at[a].tolist(), times[a].tolist(), strict=True)], dtype=object)
                out.append(pd.DataFrame({"t": t[at[a]], "place": none.astype("Int32").repeat(len(a)), "run": none.repeat(len(a)),
                                         "n": times[a].astype(np.int32), "partner": pd.array(t[at[b]], "Int64"), "places": places}))
        return pd.concat(out, ignore_index=True)

    for frame in frames:
        frame = pd.concat([tail, frame], ignore_index=True) if len(tail) else frame
        if frame.empty:
            continue
        last = frame["run"].iloc[-1]
        ends = (frame["run"] == last).to_numpy()
        if frame["t"][ends].nunique() <= HELD and (known is None or last != known[1]):
            tail, frame = frame[ends], frame[~ends].reset_index(drop=True)
            if len(frame):
                yield kinds(frame)
        else:
            tail = frame.iloc[:0]
            yield kinds(frame)
            known = (frame["t"].iloc[-1], last)
    if len(tail):
        yield kinds(tail.reset_index(drop=True))


def _least(min_words: int) -> int:
    """The least number of equal words of a passage."""
    return int(np.ceil(MIN_IDENTITY * min_words - 1e-9))


def _regions(place: np.ndarray, run: np.ndarray, least: int, several: bool, span: int = 0) -> np.ndarray:
    """(start, end) of the stretches that the runs at ``place`` could fill with passages, with ``several`` those of two runs or more.

    A passage has ``span`` words and ``least`` covered words or more, and these are ``MIN_IDENTITY`` of its words.
    """
    at = np.unique((place[:, None] + np.arange(3)).ravel())  # the covered words
    if len(at) < least:
        return np.empty((0, 2), np.int64)
    # the widest span that ends at each covered word
    rank = np.arange(len(at))
    start = np.searchsorted(np.maximum.accumulate(MIN_IDENTITY * at - rank), MIN_IDENTITY * (at + 1) - (rank + 1) - 1e-9)
    fine = start <= np.minimum(rank - least + 1, np.searchsorted(at, at + 1 - span, side="right") - 1)
    if several:
        turns = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        head = np.searchsorted(place, at[np.minimum(start, len(at) - 1)])
        tail = np.searchsorted(place, at - 2, side="right") - 1
        fine &= (tail > head) & (turns[np.maximum(tail, 0)] > turns[np.minimum(head, len(place) - 1)])
    ends = np.flatnonzero(fine)
    if not len(ends):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start[ends], kind="stable")
    s, e = at[start[ends]][order], np.maximum.accumulate((at[ends] + 1)[order])
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    return np.stack([s[np.concatenate([[0], cut])], e[np.concatenate([cut - 1, [len(s) - 1]])]], axis=1)


def _fillings(place: np.ndarray, run: np.ndarray, held: np.ndarray, begin: np.ndarray, stop: np.ndarray, is_open: np.ndarray, min_words: int) -> list[tuple]:
    """(run, open, wide, size, broken) of the frequent runs by which a text's passages near the zones (begin, stop, open) are found.

    ``size`` is null for the probes of passages of two runs or more: of each stretch
    the rarest runs, as few as leave none possible without them; wide are those
    of passages with ``min_words`` words on this side.  Else the run alone makes up
    a passage: ``size`` is its longest piece, and it is broken where words of other
    runs lie in the passage.
    """
    least, probes, out = _least(min_words), {}, []
    for span in (0, min_words):
        for s, e in _regions(place, run, least, True, span).tolist():
            near = (begin < e) & (stop > s)
            if not near.any():
                continue
            i = np.flatnonzero((place >= s) & (place + 3 <= e))
            p, values, code = place[i], *np.unique(np.stack([held[i], run[i]], axis=1), axis=0, return_inverse=True)
            code, low, high = code.ravel(), 0, len(values)
            while low < high:  # how many of the rarest runs have to go
                mid = (low + high) // 2
                if len(_regions(p[code >= mid], code[code >= mid], least, True, span)):
                    low = mid + 1
                else:
                    high = mid
            for value in values[:low, 1].tolist():
                before = probes.get(value, (False, False))
                probes[value] = (before[0] or bool(is_open[near].any()), before[1] or span > 0)
    out += [(value, opened, wide, None, None) for value, (opened, wide) in probes.items()]
    values, code, times = np.unique(run, return_inverse=True, return_counts=True)
    for v in np.flatnonzero(3 * times >= least).tolist():
        p = place[code == v]
        spans = [(s, e, near) for s, e in _regions(p, p, least, False).tolist() if (near := (begin < e) & (stop > s)).any()]
        if spans:
            at = np.unique((p[:, None] + np.arange(3)).ravel())
            pieces = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            size = max(len(w) for w in pieces if any(s <= w[0] < e for s, e, _ in spans))
            broken = any(np.searchsorted(at, e) - np.searchsorted(at, s) < e - s for s, e, _ in spans)
            out.append((int(values[v]), bool(any(is_open[near].any() for _, _, near in spans)), None, size, broken))
    return out


def _near_rare(place: np.ndarray, rare: np.ndarray, partner: np.ndarray, begin: np.ndarray, stop: np.ndarray, min_words: int) -> Iterator[int]:
    """Of the partners with common rare runs those with which a passage of a text is possible that has one of these runs.

    Equal words of a passage are covered by frequent runs or by those that are
    common with the partner; the passage lies near the zones (begin, stop).
    """
    least = _least(min_words)

    def inside(covers: np.ndarray, spots: np.ndarray) -> np.ndarray:
        covers, held = np.unique(covers), np.zeros(len(spots), bool)
        for s, e in _regions(covers, covers, least, False).tolist():
            if ((begin < e) & (stop > s)).any():
                held |= (spots >= s) & (spots + 3 <= e)
        return held

    fine = np.unique(partner[inside(np.concatenate([place, rare]), rare)])  # with the runs of all partners, first
    here = np.flatnonzero(np.isin(partner, fine))
    here = here[np.argsort(partner[here], kind="stable")]
    for a, b in _groups(partner[here]):
        spots = rare[here[a:b]]
        if inside(np.concatenate([place, spots]), spots).any():
            yield int(partner[here[a]])


def _filled(min_words: int):
    """(t, partner, open) of ``_near_rare``, open if t is, and (t, run, open, wide, size, broken) of ``_fillings``.

    Frames are sorted by t, kind (0 the pairs, 1 the frequent runs, 2 the rare
    ones, with the partner as ``run``) and place.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_key(frames, ["t"]):
            t, kind, place, then = frame["t"].to_numpy(), frame["kind"].to_numpy(), frame["place"].to_numpy(np.int64), frame["then"].to_numpy(np.int64)
            is_open, value, held, rows = frame["open"].to_numpy(bool), frame["run"].to_numpy(np.int64), frame["held"].to_numpy(np.int64), []
            for a, b in _groups(t):
                m, k = (a + int(i) for i in np.searchsorted(kind[a:b], (1, 2)))
                begin, stop = place[a:m] - WIDEN, then[a:m] + K + WIDEN
                rows += [(t[a], u, None, bool(is_open[a:m].any()), None, None, None)
                         for u in (_near_rare(place[m:k], place[k:b], value[k:b], begin, stop, min_words) if k < b else ())]
                if len(np.unique((place[m:k, None] + np.arange(3)).ravel())) >= _least(min_words):
                    rows += [(t[a], None, *f) for f in _fillings(place[m:k], value[m:k], held[m:k], begin, stop, is_open[a:m], min_words)]
            kinds = {"t": "int64", "partner": "Int64", "run": "Int64", "open": "boolean", "wide": "boolean", "size": "Int32", "broken": "boolean"}
            # as objects first: whole columns with nulls would become doubles, which round ids and runs
            yield pd.DataFrame(rows, columns=list(kinds), dtype=object).astype(kinds)

    return run


def _alike(filled: DataFrame, min_words: int) -> DataFrame:
    """(t, partner), t open, that frequent runs alone could make alike: of ``_filled``."""
    probes = filled.filter("run is not null and size is null").select("t", "run", "open", "wide")
    # of runs that the same texts hold one stands for all
    of = probes.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"), F.max("wide").alias("wide"), *[
        F.expr(f"bit_xor(xxhash64({c}))").alias(f"x{i}") for i, c in enumerate(("t", "t, open", "t, wide, 1"))])
    one = of.filter("open and wide and n > 1").groupBy("n", "x0", "x1", "x2").agg(F.min("run").alias("run"))
    probes = durable(probes.join(one.select("run"), "run", "left_semi"))
    pairs = probes.filter("open").join(probes.select("run", F.col("t").alias("partner"), F.col("wide").alias("p_wide")), "run")
    pairs = pairs.filter("wide or p_wide").select("t", "partner")

    alone = durable(filled.filter("size is not null").select("t", "run", "open", "size", "broken"))
    seek = alone.filter("open")
    # a piece without other words is as long as its passage with the longest other piece
    whole = alone.filter(F.col("size") >= min_words)
    longest = whole.groupBy("run").agg(F.max(F.struct("size", "t")).alias("a"))
    next_ = whole.join(longest, "run").filter("t <> a.t").groupBy("run").agg(F.max(F.struct("size", "t")).alias("b"))
    ends = longest.join(next_, "run").select("run", F.explode(F.array("a.t", "b.t")).alias("partner"))
    pairs = pairs.unionByName(seek.filter(F.col("size") >= min_words).join(ends, "run").select("t", "partner"))
    # pieces with other words between them are few; they meet all
    broken = alone.filter("broken").select("run", F.col("t").alias("partner"))
    every = alone.select("run", F.col("t").alias("partner"))
    pairs = pairs.unionByName(seek.filter("not broken").join(broken, "run").select("t", "partner"))
    pairs = pairs.unionByName(seek.filter("broken").join(every, "run").select("t", "partner"))
    return pairs.filter("t <> partner")


def third_matches(heavy: DataFrame, shared: DataFrame, found: DataFrame, texts: DataFrame, min_words: int) -> DataFrame | None:
    """Matches of the pairs ``heavy`` that no passage of ``found`` covers, with all other holders but those that can't make a passage."""
    parts = total_parts(texts)
    mine = heavy.select("t").distinct()
    left = _left_open(shared.join(mine, "t", "left_semi"), found.join(mine, "t", "left_semi").unionByName(
        found.join(mine.withColumnRenamed("t", "partner"), "partner", "left_semi").select(found.columns)), parts, min_words)
    open_pairs = _dealt_pairs(left, parts).filter("open")
    open_heavy = durable(open_pairs.join(heavy.select("key").distinct(), "key", "left_semi"))
    if open_heavy.isEmpty():
        return None
    holders = heavy.join(open_heavy.select("key").distinct(), "key", "left_semi")
    marked = holders.select("t", "place", "then", F.lit(False).alias("open")).unionByName(open_heavy.select("t", "place", "then", "open"))
    marked = durable(marked.groupBy("t", "place", "then").agg(F.max("open").alias("open")))
    spots = marked.groupBy("t").agg(F.max("open").alias("open"), F.collect_list(F.struct("place", "then")).alias("spots"))
    runs = texts.select("t", "codes").join(spots.hint("shuffle_hash"), "t").select("t", "open", "spots", "codes").mapInArrow(_run_rows, "t bigint, open boolean, place int, run bigint")
    kinds = durable(runs.repartition(parts, "run").sortWithinPartitions("run", "t").mapInPandas(
        _run_kinds, "t bigint, place int, run bigint, n int, partner bigint, places array<int>"))
    frequent = kinds.filter("partner is null").select("t", "place", "run", "n")
    counts = durable(frequent.groupBy("run").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("_n")))
    ranked = join_spread(frequent, counts.select("run", "held"), ["run"], "t", counts.select("run", "_n"))
    rare = kinds.filter("partner is not null").select("t", "partner", F.explode("places").alias("place"))
    zero = F.lit(0).cast("long")
    rows = marked.select("t", F.lit(0).alias("kind"), "place", "then", "open", zero.alias("run"), zero.alias("held")).unionByName(
        ranked.select("t", F.lit(1).alias("kind"), "place", F.lit(0).alias("then"), F.lit(False).alias("open"), "run", "held")).unionByName(
        rare.select("t", F.lit(2).alias("kind"), "place", F.lit(0).alias("then"), F.lit(False).alias("open"), F.col("partner").alias("run"), zero.alias("held")))
    filled = durable(rows.repartition(parts, "t").sortWithinPartitions("t", "kind", "place").mapInPandas(
        _filled(min_words), "t bigint, partner bigint, run bigint, open boolean, wide boolean, size int, broken boolean"))
    # both texts have room for a passage with their common rare runs
    able = filled.filter("partner is not null")
    back = able.select(F.col("partner").alias("t"), F.col("t").alias("partner"))
    able = able.filter("open").select("t", "partner").join(back, ["t", "partner"], "left_semi")
    pairs = durable(able.unionByName(_alike(filled, min_words)).distinct())
    # the texts are known by now, so each seed of the pairs is joined once, not with every seed near it
    ends = marked.select("t", F.explode(F.array("place", "then")).alias("place"), "open").groupBy("t", "place").agg(F.max("open").alias("open"))
    held = durable(ends.join(shared.select("t", "place", "seed"), ["t", "place"]))
    other = held.select("seed", F.col("t").alias("partner"), F.col("place").alias("other"))
    met = pairs.join(held.filter("open").select("t", "place", "seed"), "t").join(other, ["partner", "seed"])
    return durable(met.select("t", "place", "partner", "other", F.lit(True).alias("open")))


def shared_passages(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Aligned passages of ``distinct_texts``, those of all three rounds.

    Places count words from 0; ends are exclusive.
    """
    rows = durable(seed_rows(texts))
    held = rows.groupBy("seed").agg(F.min(F.struct("t", "place")).alias("a"), F.max(F.struct("t", "place")).alias("b"), F.count(F.lit(1)).alias("n"))
    known = durable(held.filter("a.t <> b.t").select(
        "seed", "n", F.col("a.t").alias("t0"), F.col("a.place").alias("p0"), F.col("b.t").alias("t1"), F.col("b.place").alias("p1")))
    shared = durable(join_spread(rows, known, ["seed"], "t", known.select("seed", F.col("n").alias("_n"))))
    ends = F.explode(F.array(F.struct(F.col("t0").alias("partner"), F.col("p0").alias("other")),
                             F.struct(F.col("t1").alias("partner"), F.col("p1").alias("other")))).alias("e")
    first = shared.select("t", "place", ends).select("t", "place", "e.*", F.lit(True).alias("open")).filter("partner <> t")
    first = passages(first, texts, min_words)
    seen = shared.select("t", "place", "seed", "n")
    again, heavy = second_matches(seen, first, total_parts(texts), min_words)
    found = first.unionByName(passages(again, texts, min_words))
    rest = third_matches(durable(heavy), seen, found, texts, min_words) if heavy is not None else None
    if rest is None:
        return found
    return found.unionByName(passages(rest, texts, min_words))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, start, end, n_words, partner, identity: what each document repeats.

    Passages of a document, both as finder and as partner, are merged; partner
    is the smallest document met in the merged span (for a whole copy its
    smallest other holder, or the largest for that one), identity the best.
    """
    texts, copies = distinct_texts(df, id_col, text_col)
    whole = join_spread(copies, texts.filter(F.col("n") >= min_words).select("t", "n"), ["t"], "doc").select(
        "t", "doc", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("n").alias("n_words"),
        F.when(F.col("doc") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("partner"), F.lit(1.0).alias("identity"))
    whole = durable(whole)
    both = both_sides(shared_passages(texts, min_words)).join(whole.select("t").distinct(), "t", "left_anti")
    # of the passages that begin at one place the longest covers the others
    spans = both.groupBy("t", "doc", "start").agg(F.max("end").alias("end"), F.min("partner").alias("partner"), F.max("identity").alias("identity"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_key(frames, ["t"]):
            rows: list[list] = []
            for t, doc, start, end, partner, identity in frame[["t", "doc", "start", "end", "partner", "identity"]].itertuples(index=False):
                if rows and rows[-1][0] == t and start <= rows[-1][3]:
                    last = rows[-1]
                    last[3], last[4], last[5] = max(last[3], end), min(last[4], partner), max(last[5], identity)
                else:
                    rows.append([t, doc, start, end, partner, identity])
            yield pd.DataFrame([[d, s, e, e - s, p, i] for _, d, s, e, p, i in rows], columns=["doc", "start", "end", "n_words", "partner", "identity"])

    dealt = spans.repartition(total_parts(df), "t").sortWithinPartitions("t", "start", "end")
    merged = dealt.mapInPandas(merge, "doc bigint, start int, end int, n_words int, partner bigint, identity double")
    return merged.unionByName(whole.drop("t"))
