"""SentencePiece encoding and decoding with the tokenizers library.

``parse`` reads the model's protobuf (pieces, scores, kinds, trainer and normaliser settings). ``backend`` rebuilds it: the normaliser
(precompiled map, extra white space), the white-space marker with its dummy prefix, the unigram scores or the merges that a BPE
model's scores imply, and byte fallback. Texts are encoded in batches by the library's threads.

A text is cut into segments before each run of markers. That changes no result where no piece has a marker after another sign
(looked up in the pieces; else texts stay whole), keeps a very long text from being one word to the merger, and lets equal segments be
encoded once. Parity: ``verify`` compares every new segment's ids (or whole texts) with the SentencePiece library; where they
differ, ``parity`` is false and the SentencePiece ids are given. ``round_trip`` tells whether decoding gives the text back.

Edge cases: a null or empty text has no ids and decodes to the empty text. A text that holds the marker sign itself decodes to
spaces (``round_trip`` false). Repeated rows each get a row. An empty table gives no rows. All columns are kept; a column
named like a result gives way to it.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import over, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Code points given to the library at once.
BATCH_CHARS = 1 << 19
#: Segments that a worker remembers.
KNOWN = 300_000
_RUN = re.compile(f"{MARK}+[^{MARK}]*")
_RUN_OR_START = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(b: bytes):
    """Numbers and values of a protobuf message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", b[i : i + n])[0]
            i += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, b[i : i + n]
            i += n
        else:
            raise ValueError(f"field kind {kind} is not part of a model")


@dataclass
class Model:
    """What a model file says. Defaults are the format's."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def parse(raw: bytes) -> Model:
    """Model from the bytes of a ``.model`` file."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append(f[1].decode("utf-8"))
            m.scores.append(f.get(2, 0.0))
            m.kinds.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(_fields(value))
            m.algorithm, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.char_map, m.dummy_prefix, m.trim = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
    if m.algorithm not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model: each way to put a piece together from two, the best-scored piece first."""
    whole = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k in (NORMAL, USER, UNUSED)}
    found = [(-s, i, (p[:j], p[j:])) for i, (p, s) in enumerate(whole.items()) for j in range(1, len(p)) if p[:j] in whole and p[j:] in whole]
    return [pair for _, _, pair in sorted(found, key=lambda x: x[:2])]


def normaliser(m: Model):
    """The tokenizers library's normaliser for a model: map, white space, dummy prefix, markers for spaces."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.char_map)] if m.char_map else []
    if m.trim:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def backend(m: Model):
    """The tokenizers library's tokenizer for a model, for text that is already normalised."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if m.algorithm == BPE:
        t = Tokenizer(models.BPE(vocab={p: i for i, p in enumerate(m.pieces)}, merges=merges(m), unk_token=m.pieces[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        t = Tokenizer(models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unk_id=m.unknown, byte_fallback=m.byte_fallback))
    if not any(MARK in p.lstrip(MARK) for p in m.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    return t


class Codec:
    """Encoder and decoder of one model; ``raw`` are the bytes of its file.

    Segments (markers and what follows) that were met before are looked up; the others of a batch are encoded by the library's
    threads and, with ``verify``, compared with SentencePiece.
    """

    def __init__(self, raw: bytes, threads: int = 2, verify: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = m = parse(raw)
        self.fast, self.normaliser = backend(m), normaliser(m)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.threads, self.verify = threads, verify
        self.plain = not m.char_map and not m.trim and m.dummy_prefix
        self.cuts = not any(MARK in p.lstrip(MARK) for p in m.pieces)
        skip = {UNKNOWN: " \u2047 ".encode(), CONTROL: b""}
        self.bytes = [skip[k] if k in skip else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.opens = np.array([p.startswith(MARK) for p in m.pieces])
        self.known: dict[str, bytes] = {}  # ids of a segment, four bytes each
        self.differs: set[str] = set()

    def segments(self, text: str) -> list[str]:
        """Normalised text cut before each run of markers."""
        if not text:
            return []
        if self.plain and self.cuts:
            if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                return text.split(" ")  # each stands for a marker and itself
            return [x[1:] for x in _RUN.findall(MARK + text.replace(" ", MARK))]
        whole = self.normaliser.normalize_str(text)
        return [whole] if not self.cuts or not whole else _RUN_OR_START.findall(whole)

    def learn(self, new: list[str]) -> None:
        """Encode segments with one marker each. Many are joined to one text, whose ids fall apart where a piece starts with a marker."""
        groups = [new[i : i + 500] for i in range(0, len(new), 500)]
        got = self.fast.encode_batch_fast(["".join(MARK + x for x in g) for g in groups], add_special_tokens=False)
        want = self.own.encode([" ".join(g) for g in groups], num_threads=self.threads) if self.verify else [None] * len(groups)
        for g, e, w in zip(groups, got, want, strict=True):
            ids = e.ids
            starts = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            if len(starts) != len(g) + 1 or (w is not None and w != ids):
                self.learn_each(g)
            else:
                raw = np.array(ids, dtype=np.int32).tobytes()
                self.known.update((x, raw[4 * i : 4 * j]) for x, i, j in zip(g, starts, starts[1:], strict=False))

    def learn_each(self, new: list[str]) -> None:
        """Encode segments one by one."""
        lead = MARK if self.plain and self.cuts else ""
        for x, e in zip(new, self.fast.encode_batch_fast([lead + x for x in new], add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, dtype=np.int32).tobytes()
        if self.verify and self.plain and self.cuts:
            for x, ids in zip(new, self.own.encode([x.replace(MARK, " ") for x in new], num_threads=self.threads), strict=True):
                # The empty segment (a lone marker) has no text that the library could be given.
                if x and self.known[x] != (raw := np.array(ids, dtype=np.int32).tobytes()):
                    self.known[x] = raw
                    self.differs.add(x)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool | None]]:
        """Ids of each text, and whether both libraries agree on all its segments (None without ``verify``)."""
        if len(self.known) > KNOWN:
            self.known.clear()
            self.differs.clear()
        cut = [self.segments(t) for t in texts]
        new = list({x for part in cut for x in part if x not in self.known})
        if self.plain and self.cuts:
            self.learn([x for x in new if MARK not in x])
            new = [x for x in new if MARK in x]
        self.learn_each(new)
        out = []
        for text, part in zip(texts, cut, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, part)), dtype=np.int32)
            same = None
            if self.verify and self.plain and self.cuts:
                same = not self.differs or self.differs.isdisjoint(part)
            elif self.verify:
                want = np.array(self.own.encode(text), dtype=np.int32)
                same = bool(np.array_equal(ids, want))
                ids = want
            out.append((ids, same))
        return out

    def decode(self, ids) -> str:
        """Text of ids."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(raw: bytes, threads: int, verify: bool) -> Codec:
    """One codec a worker."""
    key = hash((raw, threads, verify))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, threads, verify)
    return _CODECS[key]


def runs(texts: list[str | None]):
    """Slices of texts of about BATCH_CHARS code points, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BATCH_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


_RESULT = "ids array<int>, n_tokens long, n_unknown long, round_trip boolean, parity boolean"


def encode(docs: DataFrame, model_file: str, *, text_col: str = "text", threads: int = 2, verify: bool = True) -> DataFrame:
    """``docs`` with ids, n_tokens, n_unknown, round_trip and parity (null without ``verify``). The file is read on the driver."""
    small_batches(docs.sparkSession)
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(_RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(shared.value, threads, verify), []
        given = list(texts)
        for part in runs(given):
            some = [t or "" for t in given[part]]
            rows += [(ids, len(ids), int((ids == codec.model.unknown).sum()), codec.decode(ids.tolist()) == t, same) for t, (ids, same) in zip(some, codec.encode(some), strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")])

    done = docs.select(F.struct("*").alias("row"), of(F.col(text_col)).alias("s"))
    return over("row", done, {c: F.col(f"s.{c}") for c in ("ids", "n_tokens", "n_unknown", "round_trip", "parity")})


def decode(tokens: DataFrame, model_file: str, *, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``: the text of an array of ids; empty for null."""
    small_batches(tokens.sparkSession)
    with open(model_file, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        codec = _codec(shared.value, 1, False)
        return pd.Series(["" if x is None else codec.decode(list(x)) for x in ids], dtype=object)

    done = tokens.select(F.struct("*").alias("row"), of(F.col(ids_col)).alias("s"))
    return over("row", done, {"decoded": F.col("s")})
