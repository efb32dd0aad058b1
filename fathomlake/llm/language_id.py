"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier on
hashed byte trigrams of letters tells the languages with a 1 from those with a
0: a naive Bayes log odds, in which the languages of a side weigh alike.  Each
output is centred and scaled so that the two sides lie at +1 and -1.  Decoding
takes the codeword with the smallest exponential loss over all bits, each bit
weighted by how far its classifier separates the sides.  ``score`` is
``(second - best) / (second + best)`` of the two smallest losses, 0 to 1, and
a prediction under ``ambiguous_below`` is flagged.

Up to seven languages get the exhaustive code of 2^(L-1) - 1 columns, so any
two codewords differ in over half of the bits; more get random balanced columns
from a fixed seed.

Training counts trigrams over at most about ``rows_per_language`` labelled rows
of each language, picked by a hash of the id: the bound is a parameter and a
rarer language is used whole.  Prediction reads every text whole, in windows.
A null text, or one without a letter, is ``und`` with score 0.  Languages are
ordered by name; ties go to the first.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

DIM = 1 << 15
WINDOW = 1 << 20
ROWS = 512  # of a batch at once
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes: a-z for letters of either case, a space for other ASCII."""
    lut = np.arange(256, dtype=np.uint8)
    lut[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        lut[c] = lut[c - 32] = c
    return lut


LETTERS = _letters()


@dataclass(frozen=True)
class Model:
    """A fitted code: languages, their codewords (+1/-1), weights per bit."""

    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits, float32
    centre: np.ndarray
    scale: np.ndarray

    def losses(self, means: np.ndarray) -> np.ndarray:
        """rows x languages, from the rows' mean trigram weights per bit."""
        out = np.clip((means - self.centre) / self.scale, -4, 4)
        bit = self.scale / self.scale.sum()
        return (np.exp(-out[:, None, :] * self.code[None, :, :]) * bit).sum(axis=2)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1, pairwise far apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        columns = [[1 if i == 0 or i in side else -1 for i in range(n)] for k in range(n - 1) for side in combinations(range(1, n), k)]
        return np.array(columns, float).T
    draw, best, most = random.Random(7), None, -1
    for _ in range(50):
        columns = []
        for _ in range(10 * n.bit_length()):
            half = [1] * (n // 2) + [-1] * (n - n // 2)
            draw.shuffle(half)
            columns.append(half)
        code = np.array(columns, float).T
        least = min(int((a != b).sum()) for a, b in combinations(code, 2))
        if least > most:
            best, most = code, least
    return best


def _grams(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed trigram, row) in windows; ``ends`` are the rows' ends in data."""
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(data), WINDOW):
        stop = min(len(data), at + WINDOW + 2)
        part = LETTERS[data[at:stop]].astype(np.uint32)
        if len(part) < 3:
            continue
        row = np.repeat(np.arange(len(ends)), np.clip(ends, at, stop) - np.clip(starts, at, stop))
        ok = (part[1:-1] != 32) & (row[:-2] == row[2:])
        h = ((part[:-2] * 263 + part[1:-1]) * 263 + part[2:]) & (DIM - 1)
        yield h[ok], row[:-2][ok]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 2000,
    max_languages: int = 500,
) -> Model | None:
    """Fit on the labelled rows of ``df``; None if there is none.

    A column with over ``max_languages`` values is no language column: an error.
    """
    labelled = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(max_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    names = sorted(counts)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(rows_per_language / counts[n]))])
    sample = labelled.filter(draw < share[F.col(lang_col)]).select(
        (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(lang_col)) - 1).cast("int").alias("lang"),
        F.col(text_col).alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sums of a batch; the rest is Spark's
            lang = batch.column(0).to_numpy()
            for h, row in _grams(*_flat(batch.column(1))):
                at, n = np.unique(lang[row].astype(np.int64) * DIM + h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["at", "n"])

    rows = sample.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(names) * DIM)
    table[rows["at"].to_numpy()] = rows["n"].to_numpy()
    table = table.reshape(len(names), DIM) + 0.1
    shares = table / table.sum(axis=1, keepdims=True)

    code = codewords(len(names))
    if len(names) == 1:
        zero = np.zeros((DIM, 1), np.float32)
        return Model(tuple(names), code, zero, np.array([-1.0]), np.array([1.0]))
    weights, centre, scale = [], [], []
    for column in code.T:
        one, zero = shares[column > 0].mean(axis=0), shares[column < 0].mean(axis=0)
        odds = np.log(one / zero)
        high, low = one @ odds, zero @ odds
        weights.append(odds)
        centre.append((high + low) / 2)
        scale.append(max((high - low) / 2, 1e-9))
    return Model(tuple(names), code, np.array(weights, np.float32).T.copy(), np.array(centre), np.array(scale))


def predict(
    df: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    ambiguous_below: float = 0.05,
) -> DataFrame:
    """id, lang_pred, score and ambiguous for every row, after columns ``keep``.

    ``text_col`` may be among ``keep``.
    Only the text decides.  Without a model every row is ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = pc.fill_null(batch.column(spot), "")
            n = len(texts)
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if model is not None and n:
                data, ends = _flat(texts)
                sums, grams = np.zeros((n, model.weights.shape[1])), np.zeros(n)
                for h, row in _grams(data, ends):
                    if len(row):
                        cuts = np.flatnonzero(np.diff(row, prepend=-1))
                        sums[row[cuts]] += np.add.reduceat(model.weights[h], cuts, axis=0)
                        grams[row[cuts]] += np.diff(cuts, append=len(row))
                loss = model.losses(sums / np.maximum(grams, 1)[:, None])
                best = loss.argmin(axis=1)
                low = np.sort(loss, axis=1)
                if loss.shape[1] > 1:
                    scores = (low[:, 1] - low[:, 0]) / (low[:, 1] + low[:, 0])
                else:
                    scores = np.ones(n)
                ascii_letter = np.zeros(n, bool)
                for at in range(0, len(data), WINDOW):
                    part = data[at : at + WINDOW]
                    here = np.flatnonzero((part < 128) & (LETTERS[part] != 32)) + at
                    ascii_letter[np.searchsorted(ends, here, side="right")] = True
                for i in range(n):
                    if ascii_letter[i] or any(c.isalpha() for c in texts[i].as_py()):
                        names[i] = model.languages[best[i]]
                    else:
                        scores[i] = 0.0
            known = np.array([x != UNKNOWN for x in names], bool)
            out = [*batch.columns[:given_columns], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                   pa.array(known & (scores < ambiguous_below), pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    given_columns = 1 + len(keep)
    spot = 1 + keep.index(text_col) if text_col in keep else given_columns
    text = [] if text_col in keep else [text_or_empty(text_col).alias("_text")]  # no text travels twice
    given = df.select(F.col(id_col), *[F.col(c) for c in keep], *text)
    schema = given.select(*given.columns[:given_columns], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema
    return given.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """The rows that no fit sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
