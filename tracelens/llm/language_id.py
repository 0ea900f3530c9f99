"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the pieces of a SentencePiece model, with its byte pieces for signs that are no piece. Each
language has its own probability for every piece. A word's probability in a language is the sum, over all ways to cut it into
pieces, of the products of the pieces' probabilities; a forward algorithm over the word's places sums them without listing them.
A text's words are its runs of letters, lower-cased, each behind the white-space marker. No piece reaches over a marker, so a text's
sum over all segmentations is the product of its words' sums, and equal words are summed once.

Learning is expectation-maximisation over all training rows: words are counted per language (merged before the shuffle), every
word's expected piece counts come from forward and backward sums, and only (language, piece) totals, bounded by the vocabulary, reach
the driver. Expected counts are added as whole multiples of 2**-20, so no result depends on the order of tasks.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0; so is every text where no training row has a
language and a letter. Ties go to the language that comes first in code-point order. Rows with a null language or text teach
nothing; a null id is a training row. Repeated rows count each and each get a row. An empty table gives no rows. Very long words and
texts are summed whole. All languages found are learned; above ``MAX_LANGUAGES``, where the table of probabilities would not be
bounded any more, ``fit`` raises an error. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import small_batches, written
from tracelens.llm.sentencepiece_codec import BYTE, MARK, NORMAL, parse

UNDETERMINED = "und"
MAX_LANGUAGES = 1000
#: Expected counts are sums of whole multiples of 1 / UNIT.
UNIT = float(1 << 20)
#: Distinct words that a task holds at once.
KNOWN = 500_000
#: Words whose expected counts are made together.
AT_ONCE = 100_000
#: Longest word whose products cannot fall out of a double's range.
PLAIN = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def _codes(some: list[str]) -> np.ndarray:
    """Code points of words of one length: words x places."""
    return np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), -1).astype(np.uint64)


def _rolled(codes: np.ndarray) -> np.ndarray:
    """Hash of each beginning of each word, the empty one first: words x places + 1."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i]
    return out


class Vocabulary:
    """Pieces that can occur in a marked word, byte pieces behind them.

    Substrings are looked up by a 64-bit rolling hash in a table with one place a hash; what finds its place taken is in a second table.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces) + 256
        h = np.array([int(_rolled(_codes([p]))[0, -1]) for p in pieces], dtype=np.uint64)
        self.tables = []
        left = np.arange(len(pieces))
        while len(left):
            bits = max(8, int(len(left) * 32).bit_length())
            factor = BASE + np.uint64(2 * len(self.tables) + 2)
            place = (h[left] * factor) >> np.uint64(64 - bits)
            _, first = np.unique(place, return_index=True)
            keys, rows = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)
            keys[place[first]], rows[place[first]] = h[left[first]], left[first] + 1
            self.tables.append((factor, np.uint64(64 - bits), keys, rows))
            left = np.delete(left, first)

    @classmethod
    def of(cls, raw: bytes) -> Vocabulary:
        """From a model file: pieces of letters, with or without the marker in front."""
        m = parse(raw)
        if not m.byte_fallback or m.kinds.count(BYTE) != 256:
            raise ValueError("the vocabulary needs byte pieces")
        one = re.compile(f"{MARK}?[^\\W\\d_]*")
        return cls([p for p, k in zip(m.pieces, m.kinds, strict=True) if k == NORMAL and p and one.fullmatch(p)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, counted from 1; 0 for none."""
        out = np.zeros(h.shape, dtype=np.int32)
        for factor, shift, keys, rows in self.tables:
            place = (h * factor) >> shift
            out = np.where(keys[place] == h, rows[place], out)
        return out


@dataclass
class Lattices:
    """The cuts of words of one length: per end, length and word the row of a table of weights (row 0 is none)."""

    rows: np.ndarray
    signs: list[int] = field(default_factory=list)  # code points spelt in bytes; their rows follow the vocabulary's

    @classmethod
    def of(cls, vocabulary: Vocabulary, some: list[str]) -> Lattices:
        codes = _codes([MARK + w for w in some])
        n = codes.shape[1]
        wide = min(n, vocabulary.longest)
        rows = np.zeros((n + 1, wide + 1, len(some)), dtype=np.int32)
        start = _rolled(codes)
        for k in range(1, wide + 1):
            power = np.uint64(pow(int(BASE), k, 1 << 64))
            rows[k:, k] = vocabulary.find(start[:, k:] - start[:, : n + 1 - k] * power).T
        missing = rows[1:, 1].T == 0
        signs: list[int] = []
        if missing.any():
            found, place = np.unique(codes[missing], return_inverse=True)
            signs = found.astype(np.int64).tolist()
            w, at = np.nonzero(missing)
            rows[at + 1, 1, w] = vocabulary.size + 1 + place
        return cls(rows, signs)


def spelt(log_p: np.ndarray, first_byte: int, signs: list[int]) -> np.ndarray:
    """``log_p`` (a row a piece) behind a row of minus infinity, followed by a row for each sign: the sum of its bytes' rows."""
    more = [log_p[[first_byte + x for x in chr(s).encode("utf-8", "surrogatepass")]].sum(axis=0) for s in signs]
    return np.vstack([np.full((1, log_p.shape[1]), -np.inf), log_p, *more])


def forward(rows: np.ndarray, table: np.ndarray, plain: bool) -> np.ndarray:
    """Sums over all cuts up to each place: places x words x languages, as products (``plain``) or as logarithms."""
    places, wide, n = rows.shape
    out = np.full((places, n, table.shape[1]), 0.0 if plain else -np.inf)
    out[0] = 1.0 if plain else 0.0
    for j in range(1, places):
        for k in range(1, min(j, wide - 1) + 1):
            hit = np.flatnonzero(rows[j, k])
            if len(hit):
                weight = table[rows[j, k, hit]]
                if plain:
                    out[j, hit] += out[j - k, hit] * weight
                else:
                    out[j, hit] = np.logaddexp(out[j, hit], out[j - k, hit] + weight)
    return out


def by_length(some: list[str], at_once: int = 200_000) -> list[list[int]]:
    """Places of words of equal length, in groups of about ``at_once`` signs."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        groups.setdefault(len(w), []).append(i)
    return [g[s : s + max(1, at_once // (n + 1))] for n, g in sorted(groups.items()) for s in range(0, len(g), max(1, at_once // (n + 1)))]


def log_sums(vocabulary: Vocabulary, log_p: np.ndarray, some: list[str]) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.empty((len(some), log_p.shape[1]))
    for g in by_length(some):
        lattices = Lattices.of(vocabulary, [some[i] for i in g])
        table = spelt(log_p, len(vocabulary.pieces), lattices.signs)
        plain = len(some[g[0]]) < PLAIN and not lattices.signs
        last = forward(lattices.rows, np.exp(table) if plain else table, plain)[-1]
        out[g] = np.log(last) if plain else last
    return out


def expected(vocabulary: Vocabulary, log_p: np.ndarray, some: list[str], langs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of each piece, per language, in words of language number ``langs`` that occur ``counts`` times."""
    out = np.zeros(log_p.shape[::-1])
    first_byte = len(vocabulary.pieces)
    for g in by_length(some):
        lattices = Lattices.of(vocabulary, [some[i] for i in g])
        plain = len(some[g[0]]) < PLAIN and not lattices.signs
        own, n = langs[g], counts[g].astype(np.float64)
        table = spelt(log_p, first_byte, lattices.signs)
        size = len(table)
        # Language by language, so that a word's rows are those of its language; row 0 stays the one that is none.
        weight = (np.exp(table) if plain else table).T.ravel()
        rows = np.where(lattices.rows > 0, lattices.rows + (own * size).astype(np.int32), 0)
        ahead = forward(rows, weight[:, None], plain)[:, :, 0]
        places, wide, _ = rows.shape
        behind = np.full(ahead.shape, 0.0 if plain else -np.inf)
        behind[-1] = 1.0 if plain else 0.0
        flat = np.zeros(len(weight))
        for j in range(places - 1, 0, -1):
            for k in range(1, min(j, wide - 1) + 1):
                hit = np.flatnonzero(rows[j, k])
                if len(hit):
                    at = rows[j, k, hit]
                    if plain:
                        step = weight[at] * behind[j, hit]
                        behind[j - k, hit] += step
                        share = ahead[j - k, hit] * step / ahead[-1, hit]
                    else:
                        step = weight[at] + behind[j, hit]
                        behind[j - k, hit] = np.logaddexp(behind[j - k, hit], step)
                        share = np.exp(ahead[j - k, hit] + step - ahead[-1, hit])
                    np.add.at(flat, at, share * n[hit])
        per = flat.reshape(log_p.shape[1], size)
        out += per[:, 1 : vocabulary.size + 1]
        for s, c in zip(lattices.signs, per[:, vocabulary.size + 1 :].T, strict=True):
            for x in chr(s).encode("utf-8", "surrogatepass"):
                out[:, first_byte + x] += c
    return out


@dataclass
class Model:
    """Languages in code-point order and the logarithms of their pieces' probabilities (a row a piece, byte pieces last)."""

    vocabulary: Vocabulary
    langs: list[str]
    log_p: np.ndarray


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of the columns lang and t; merged in the tasks before the shuffle."""

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for lang, t in zip(batch["lang"], batch["t"], strict=True):
                held.update((lang, w) for w in words(t))
                if len(held) > KNOWN:
                    yield _counter(held)
                    held.clear()
        if held:
            yield _counter(held)

    return rows.mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counter(held: Counter) -> pd.DataFrame:
    return pd.DataFrame({"lang": [k[0] for k in held], "word": [k[1] for k in held], "n": list(held.values())})


def fit(docs: DataFrame, pieces: str, *, text_col: str = "text", lang_col: str = "lang", rounds: int = 2, smooth: float = 0.05) -> Model:
    """Model learned from all rows of ``docs`` that have a text and a language, in ``rounds`` of expectation and maximisation.

    ``smooth`` is added to every piece's expected count.
    """
    small_batches(docs.sparkSession)
    with open(pieces, "rb") as f:
        vocabulary = Vocabulary.of(f.read())
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    counts = written(word_counts(rows))
    langs = [r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs.sort()
    number = {x: i for i, x in enumerate(langs)}
    log_p = np.full((vocabulary.size, len(langs)), -np.log(vocabulary.size))

    def estimated(held):
        def of(batches):
            voc, p = held.value
            total = np.zeros(p.shape[::-1])
            rows: list[pd.DataFrame] = []

            def add() -> None:
                b = pd.concat(rows)
                np.add(total, expected(voc, p, b["word"].tolist(), b["lang"].map(number).to_numpy(dtype=np.int64), b["n"].to_numpy()), out=total)
                rows.clear()

            for b in batches:
                rows.append(b)
                if sum(map(len, rows)) >= AT_ONCE:
                    add()
            if rows:
                add()
            whole = np.rint(total * UNIT).astype(np.int64)
            at, piece = np.nonzero(whole)
            yield pd.DataFrame({"at": at.astype(np.int32), "piece": piece.astype(np.int32), "n": whole[at, piece]})

        return of

    for _ in range(rounds if langs else 0):
        held = docs.sparkSession.sparkContext.broadcast((vocabulary, log_p))
        sums = counts.mapInPandas(estimated(held), "at int, piece int, n long").groupBy("at", "piece").agg(F.sum("n").alias("n")).toPandas()
        mass = np.full((len(langs), vocabulary.size), smooth)
        mass[sums["at"], sums["piece"]] += sums["n"].to_numpy(dtype=np.float64) / UNIT
        log_p = np.log(mass / mass.sum(axis=1, keepdims=True)).T.copy()
        held.destroy()
    return Model(vocabulary, langs, log_p)


class Scorer:
    """Scores texts; remembers the sums of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.empty((0, len(self.model.langs)))

    def judge(self, texts) -> list[tuple[str, float]]:
        """Language and probability of each text."""
        split = [words(t) for t in texts]
        if len(self.place) > KNOWN:
            self._forget()
        new = list(dict.fromkeys(w for w in chain.from_iterable(split) if w not in self.place))
        if new and self.model.langs:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.sums = np.vstack([self.sums, log_sums(self.model.vocabulary, self.model.log_p, new)])
        out = []
        for w in split:
            if not w or not self.model.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            x = self.sums[np.fromiter(map(self.place.__getitem__, w), dtype=np.int64, count=len(w))].sum(axis=0)
            best = int(x.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(x - x[best]).sum())))
        return out


def identify(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    """Struct of ``lang`` and ``score``, the probability of the language where all are alike likely before."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pd.DataFrame(scorer.judge(texts), columns=["lang", "score"])

    return judged(F.col(text_col))
