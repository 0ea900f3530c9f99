"""Merkle manifest, language identification and spelling variants against brute force, and their edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import language_id, merkle, spelling
from tracelens.llm.common import crc32_mod
from tracelens.llm.queries import PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "s", "k", "n", "word", "bits", "place", "total", "path", "slots", "digest", "leaf", "root", "id", "t", "near"]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES]) if clashes else df


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(t):
    return t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def climb(nodes):
    """Remaining node and, for each given one, what stands left and right of its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            ways[leaf].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[leaf] = place // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def brute_manifest(rows):
    by_source = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = digest(*map(framed, (doc, source, lang, n, text)))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by_source[source].append((doc is None, doc or 0, leaf, digest(*map(framed, (doc, source, lang, n, lowered(text)))) if tampered else leaf, doc))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:4])]) for s in sources}
    root, above = climb([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for (_, _, leaf, folded, doc), way in zip(sorted(by_source[s], key=lambda x: x[:4]), trees[s][1], strict=True):
            got = folded
            for left, right in way + up:
                got = digest(left, got, right)
            out.append((doc, leaf, trees[s][0], root, digest(*[x + y for x, y in way + up]), got, got == root))
    return sorted(map(repr, out))


def manifest(df):
    got = merkle.manifest(df, fields=["doc_id", "source", "lang", "n_chars", "text"], tampered=crc32_mod("doc_id", 5) == 0)
    return got, sorted(repr(tuple(r)) for r in got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def some_rows(n, seed, sources):
    draw = random.Random(seed)
    rows = [(i * draw.choice([1, 1, 7]) - 40 if i % 9 else draw.randrange(-(1 << 62), 1 << 62), f"Text {i} Ä", draw.choice(["en", None]), draw.choice(sources), i) for i in range(n)]
    rows += draw.sample(rows, n // 10) * 2  # repeated rows
    rows += [(rows[i][0], f"other {i}", None, rows[i][3], None) for i in range(0, n, 11)]  # repeated ids
    return rows + [(None, t, "en", sources[0], 1) for t in (None, "", "A", "A", "B")]


@pytest.mark.parametrize(("n", "sources"), [(300, ["a", "ä", None, "b"]), (40, [f"s{i}" for i in range(37)]), (600, ["one"])])
def test_manifest_equals_brute_force(spark, n, sources):
    rows = some_rows(n, n, sources)
    got, found = manifest(frame(spark, rows))
    assert found == brute_manifest(rows)
    places = sorted((repr(r["source"]), r["place"]) for r in got.collect())
    size = Counter(s for s, _ in places)
    assert places == [(s, i) for s in sorted(size) for i in range(size[s])]


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(3, "Only", "en", "s", 4)]
    assert manifest(frame(spark, rows, clashes=True))[1] == brute_manifest(rows)
    assert manifest(frame(spark, [], clashes=True))[1] == []


def test_many_equal_rows_take_places_side_by_side(spark):
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    got = merkle.manifest(df, fields=["doc_id", "text"]).agg(F.count("*"), F.count_distinct("place"), F.max("place"), F.count_distinct("root"), F.min("verified")).first()
    assert tuple(got) == (10_000, 10_000, 9_999, 1, True)


# Language identification


def toy():
    """A vocabulary of a few pieces, and random probabilities in two languages."""
    v = language_id.Vocabulary([*"▁abc", "ab", "bc", "▁a", "abc", "ca"])
    p = np.random.default_rng(3).random((v.size, 2))
    return v, np.log(p / p.sum(axis=0))


def cuts(v, word):
    """All ways to cut a marked word into pieces; signs that are no piece are spelt in bytes."""
    if not word:
        yield []
    ids = {p: i for i, p in enumerate(v.pieces)}
    for n in range(1, len(word) + 1):
        head = word[:n]
        pieces = [ids[head]] if head in ids else [len(v.pieces) + b for b in head.encode()] if n == 1 else None
        if pieces:
            for rest in cuts(v, word[n:]):
                yield pieces + rest


WORDS = ["a", "abc", "abcabc", "caab", "xab", "abxß", "", "abcabcabcabcabcabcab"]


def test_every_piece_is_found():
    with open(PIECES, "rb") as f:
        v = language_id.Vocabulary.of(f.read())
    h = np.array([language_id._rolled(language_id._codes([p]))[0, -1] for p in v.pieces], dtype=np.uint64)
    assert (v.find(h) == np.arange(1, len(h) + 1)).all() and not v.find(h ^ np.uint64(1 << 63)).any() and len(v.tables) <= 4


def test_forward_sums_all_segmentations():
    v, log_p = toy()
    want = np.array([np.logaddexp.reduce([log_p[c].sum(axis=0) for c in cuts(v, "▁" + w)], axis=0) for w in WORDS])
    assert np.allclose(language_id.log_sums(v, log_p, WORDS), want)


def test_expected_counts_equal_brute_force():
    v, log_p = toy()
    langs, counts = np.array([i % 2 for i in range(len(WORDS))]), np.arange(1, len(WORDS) + 1)
    want = np.zeros((2, v.size))
    for w, lang, n in zip(WORDS, langs, counts, strict=True):
        ways = [np.array(c) for c in cuts(v, "▁" + w)]
        p = np.exp([log_p[c, lang].sum() for c in ways])
        for c, x in zip(ways, p / p.sum(), strict=True):
            np.add.at(want[lang], c, n * x)
    assert np.allclose(language_id.expected(v, log_p, WORDS, langs, counts), want)


def test_long_words_stay_finite():
    v, log_p = toy()
    assert np.isfinite(language_id.log_sums(v, log_p, ["abc" * 3000, "ß" * 500])).all()


def test_fit_and_identify(spark):
    draw = random.Random(8)
    kinds = {"aa": ["shing", "thest", "other", "wing"], "bb": ["lichkeit", "unge", "schaft", "derer"]}
    text = lambda k: " ".join("".join(draw.choices(kinds[k], k=draw.randrange(1, 3))) for _ in range(12))
    rows = [(i, text(k), k, "s", 1) for i, k in enumerate(["aa", "bb"] * 60)]
    docs = frame(spark, rows, clashes=True)
    model = language_id.fit(docs.where("doc_id < 60"), PIECES)
    assert model.langs == ["aa", "bb"] and np.allclose(np.exp(model.log_p).sum(axis=0), 1)
    got = {r["doc_id"]: r["j"] for r in docs.select("doc_id", language_id.identify(model, docs).alias("j")).collect()}
    assert all(got[i]["lang"] == k and got[i]["score"] > 0.9 for i, _, k, *_ in rows)
    # The order of the rows changes nothing.
    again = language_id.fit(docs.where("doc_id < 60").repartition(3, "text"), PIECES)
    assert (again.log_p == model.log_p).all()


def test_languages_of_odd_rows(spark):
    long = "schaft unge " * 50_000
    rows = [(1, None, "aa", "s", 0), (2, "", "aa", "s", 0), (3, " 12 ._!", "bb", "s", 0), (None, "unge", "bb", "s", 0), (4, long, "bb", None, 0), (4, long, None, None, 0), (5, "wing", "aa", "s", 0)]
    docs = frame(spark, rows, clashes=True)
    model = language_id.fit(docs, PIECES)
    got = Counter((r["doc_id"], r["j"]["lang"], 0 <= r["j"]["score"] <= 1) for r in docs.select("doc_id", language_id.identify(model, docs).alias("j")).collect())
    assert got == Counter({(1, "und", True): 1, (2, "und", True): 1, (3, "und", True): 1, (None, "bb", True): 1, (4, "bb", True): 2, (5, "aa", True): 1})
    for none in (frame(spark, []), docs.where("lang = 'x'")):
        empty = language_id.fit(none, PIECES)
        assert empty.langs == [] and {tuple(r["j"]) for r in docs.select(language_id.identify(empty, docs).alias("j")).collect()} == {("und", 0.0)}
    assert none.select(language_id.identify(model, none).alias("j")).collect() == []


# Spelling variants


def brute_variants(words):
    signs = {c for w in words for c in w}
    out = []
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i, c in product(range(len(w)), signs)} | {w[:i] + c + w[i:] for i, c in product(range(len(w) + 1), signs)}
        near[w] = sorted((-words[e], e) for e in edits - {w} if e in words)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n else None for w, n in words.items()}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(map(repr, out))


def some_words(seed, n=400):
    draw = random.Random(seed)
    return {"".join(draw.choices("abcé", k=draw.choice([5, 5, 6, 6, 7]))): draw.choice([3, 4, 9, 20, 50, 200]) for _ in range(n)} | {"z" * 300: 5, "z" * 301: 11}


@pytest.mark.parametrize("limit", [1 << 20, 256])
def test_variants_equal_brute_force(spark, limit):
    """Also with filters of several rounds and slices."""
    words = some_words(limit)
    sizes = Counter(map(len, words))
    assert (len(spelling.layout(sizes, limit)) > 1) == (limit == 256)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), limit=limit)
    assert sorted(repr(tuple(r)) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute_variants(words)


def test_rounds_keep_their_bound():
    for limit in (64, 1000, 1 << 20):
        rounds = spelling.layout({5: 10_000, 6: 3, 9: 77}, limit)
        assert all(sum(n * 8 for _, n, _ in r.values()) <= limit for r in rounds)
        for length in (5, 6, 9):
            parts = [k[1] for r in rounds for k in r if k[0] == length]
            assert sorted(parts) == list(range(len(parts)))


def test_edit_hashes_equal_the_edits(spark):
    some = ["abcdé", "zzzzz", "aabba"]
    signs = spelling._signs(some)
    for w, row in zip(some, spelling.deletions(signs), strict=True):
        assert row.tolist() == [int(spelling.hashes(spelling._signs([w[:i] + w[i + 1 :]]))[0]) for i in range(5)]


def brute_vocabulary(rows):
    out = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
            out[w if h % 3 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_vocabulary_equals_brute_force(spark):
    draw = random.Random(2)
    pool = ["".join(draw.choices("abÉéA", k=draw.choice([4, 5, 6, 9]))) for _ in range(60)]
    rows = [(i if i % 7 else None, "-".join(draw.choices(pool, k=40)), "en", "s", 1) for i in range(40)] + [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 100_000 + " 1", None, None, 0)] * 3
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame(spark, rows, clashes=True), misspell=3).collect()}
    assert got == brute_vocabulary(rows) and len(got) > 20


def test_variants_of_no_text(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []
