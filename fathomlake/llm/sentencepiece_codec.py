"""SentencePiece encoding and decoding with the ``tokenizers`` library.

``Model.parse`` reads the model protobuf: pieces with score and type, model
type, byte fallback and the normaliser's switches.  ``Model.tokenizer`` builds
the same model for the ``tokenizers`` library: the normaliser, the metaspace
marker, then either a unigram model with the pieces' scores or a BPE whose
merges are rebuilt from the scores, both with byte fallback.

Where no piece goes on past the start of a word and the normaliser only marks
spaces, words are independent: a batch's distinct words that the worker has not
met lately are encoded and decoded, as one multithreaded batch (``threads`` of
a task), and texts are put together from them.  Other models encode and decode
whole texts.

Parity with the reference implementation is verified on everything that the
library encodes: on each word when the worker meets it, or on each text of the
other models.  Where one differs, that word or text alone takes the reference's
ids, so results never depend on the backend; ``backend`` names the reference in
every row that holds such a word.

Null text encodes to no ids, as empty text does.  The vocabulary file is read by
the driver and travels to the tasks as bytes; its path is a parameter.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _float(raw: bytes) -> float:
    return struct.unpack("<f", raw)[0]


@dataclass(frozen=True)
class Model:
    raw: bytes = field(repr=False)
    pieces: tuple[tuple[str, float, int], ...] = field(repr=False)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), _float(f[2]) if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        return cls(
            raw, tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
            bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        )

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def _merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best piece first."""
        known = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        rows = []
        for piece, score in known.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in known and b in known:
                    rows.append((-score, -known[a], -known[b], a, b))
        return [(a, b) for *_, a, b in sorted(rows)]

    @property
    def _inner_marks(self) -> bool:
        return any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    @property
    def words_are_independent(self) -> bool:
        return not (self._inner_marks or self.charsmap or self.remove_extra_whitespaces) and self.escape_whitespaces

    def tokenizer(self, whole: bool = True):
        """The model for whole texts, or for words that have their space."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.model_type == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown_id, self.byte_fallback)
        elif self.model_type == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self._merges(), unk_token=self.pieces[self.unknown_id][0],
                              byte_fallback=self.byte_fallback, fuse_unk=True)
        else:
            raise ValueError(f"model type {self.model_type} is neither unigram nor BPE")
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.add_dummy_prefix and whole:
            steps.append(normalizers.Prepend(MARK if self.escape_whitespaces else " "))
        if self.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if not self._inner_marks:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        prefix = [decoders.Strip(" ", 1, 0)] if self.add_dummy_prefix and whole else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *prefix])
        return out


class _Codec:
    """A worker's backends, and the words that it has met lately."""

    WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
    HELD = 150_000  # words of a generation; no effect on results

    def __init__(self, model: Model):
        import sentencepiece

        self.model, self.fast = model, model.tokenizer()
        self.words = model.tokenizer(whole=False) if model.words_are_independent else None
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
        self.opens = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.lead = " " if model.add_dummy_prefix else ""
        self.marker = self.reference.piece_to_id(MARK)
        self.met: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        #: Words that decode to something else, and words that took the reference's ids: both few.
        self.lossy: set[str] = set()
        self.odd: set[str] = set()

    def split(self, text: str) -> list[str]:
        """The text's words, each with its leading spaces; one space goes unsaid."""
        if not text:
            return []
        if self.lead and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        words = self.WORD.findall(self.lead + text)
        return [w[1:] if w[0] == " " != w[1:2] and len(w) > 1 and MARK not in w else w for w in words] if self.lead else words

    def learn(self, words: set[str], threads: int) -> None:
        """Encode and decode the words that were not met; drop the ones met long ago."""
        if len(self.met) > self.HELD:
            self.before, self.met = self.met, {}
        missing = words - self.met.keys()
        known = missing & self.before.keys()
        self.met.update((w, self.before[w]) for w in known)
        new = list(missing - known)
        plain = [w for w in new if self.lead and w[0] not in (" ", MARK)]
        other = [w for w in new if not self.lead or w[0] in (" ", MARK)]
        ids = [tuple(e.ids) for e in self.words.encode_batch_fast(other, add_special_tokens=False)]
        # A word with one space has one piece that begins with the marker: its first.
        runs = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        joined = [" " + " ".join(r) for r in runs]
        for run, e in zip(runs, self.words.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            got = e.ids
            cuts = [*np.flatnonzero(self.opens[got]).tolist(), len(got)]
            if len(cuts) == len(run) + 1:
                ids += [tuple(got[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                ids += [tuple(e.ids) for e in self.words.encode_batch_fast([" " + w for w in run], add_special_tokens=False)]
        new = other + plain
        # The reference puts the lead itself.
        asked = [w[1:] if self.lead and w[0] in (" ", MARK) else w for w in new]
        for i, right in enumerate(self.reference.encode(asked, num_threads=threads)):
            right = tuple(right) if asked[i] or not self.lead else (self.marker,)
            if right != ids[i]:
                ids[i] = right
                self.odd.add(new[i])
        said = self.words.decode_batch(list(map(list, ids)), skip_special_tokens=False)
        lead = self.lead
        self.lossy.update(w for w, d in zip(new, said, strict=True) if d != (w if not lead or w[0] in (" ", MARK) else lead + w))
        self.met.update(zip(new, ids, strict=True))

    def encode(self, texts: list[str], threads: int = 1) -> tuple[list, list[bool], list[bool]]:
        """Of each text its ids, does decoding give it back, is the library's encoding the reference's."""
        if self.words is None:
            ids = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
            right = self.reference.encode(texts, num_threads=threads)
            return right, [a == b for a, b in zip(self.decode(right), texts, strict=True)], [a == b for a, b in zip(ids, right, strict=True)]
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)), threads)
        get = self.met.__getitem__
        same = [self.lossy.isdisjoint(ws) for ws in split] if self.lossy else [True] * len(texts)
        equal = [self.odd.isdisjoint(ws) for ws in split] if self.odd else [True] * len(texts)
        return [list(chain.from_iterable(map(get, ws))) for ws in split], same, equal

    def decode(self, ids: list) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


_OPEN: dict[int, _Codec] = {}


def _codec(model: Model) -> _Codec:
    key = hash(model.raw)
    if key not in _OPEN:
        _OPEN[key] = _Codec(model)
    return _OPEN[key]


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model.parse(file.read())


def encode(
    df: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    threads: int | None = None,
) -> DataFrame:
    """id, ``keep``, ids and decoded (does decoding give the text back).

    A text that holds the marker itself decodes to spaces.  ``threads`` are those
    of a batch in a task: the session's CPUs of a task, two at least.
    ``backend`` names what encoded the row.
    """
    threads = threads or max(2, int(df.sparkSession.conf.get("spark.task.cpus", "1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        codec = _codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids, same, equal = codec.encode(texts, threads)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.concatenate([np.empty(0, np.int32), *(np.asarray(i, np.int32) for i in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                out = [*part.columns[:-1], lists, pa.array(same, pa.bool_()), pa.array(["tokenizers" if e else "sentencepiece" for e in equal], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    given = df.select(F.col(id_col), *[F.col(c) for c in keep], text_or_empty(text_col).alias("_text"))
    schema = given.select(*given.columns[:-1], F.array().cast("array<int>").alias("ids"), F.lit(False).alias("decoded"), F.lit("").alias("backend")).schema
    return given.mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``df`` with the text of each id list; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = codec.decode([i or [] for i in ids])
            texts = [None if i is None else t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema
    return df.mapInArrow(run, schema)
