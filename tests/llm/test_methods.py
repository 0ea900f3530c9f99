"""Operators against brute-force versions of what they say."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tracelens.llm import exact_topk, html_extraction, line_dedup, line_rules, mixing, ngram_lm, quality_classifier, sentencepiece_codec, simhash, url_filter
from tracelens.llm.common import components
from tracelens.llm.queries import PIECES, URL_RULES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def some_docs(n=60, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(draw.choice("the of and to in a is that it was for on".split()) + str(draw.randrange(40)) for _ in range(draw.randrange(1, 12))) for _ in range(draw.randrange(1, 8))]
        out.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# Line dedup


def test_chunks_cover_the_text_and_resist_shifts():
    draw = random.Random(3)
    lines = [f"line {draw.randrange(10**6)}" for _ in range(200)]
    plain = line_dedup.chunks("\n".join(lines))
    assert [a for a, _, _ in plain] == [0, *[b for _, b, _ in plain[:-1]]] and plain[-1][1] == 200
    shifted = line_dedup.chunks("\n".join(["new", *lines]))
    assert len({(a + 1, b + 1) for a, b, _ in plain} & {(a, b) for a, b, _ in shifted}) > 0.8 * len(plain)


def test_repeated_passages_go_and_first_stays(spark):
    draw = random.Random(5)
    fresh = lambda: "own " + " ".join(str(draw.randrange(10**9)) for _ in range(6))
    passage = [f"passage line {i} of many" for i in range(30)]
    long_line = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, "\n".join([fresh(), fresh(), *passage, fresh(), long_line, fresh()]), "en", "s", 0) for i in range(1, 6)] + [(9, "\n".join(fresh() for _ in range(20)), "en", "s", 0)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[9]["text"] == rows[5][1]
    for i in range(2, 6):
        kept = got[i]["text"].split("\n")
        # Only the chunks at the passage's edges, which hold other lines too, may stay.
        assert long_line not in kept and sum(x.startswith("passage") for x in kept) <= 8
        assert [x for x in rows[i - 1][1].split("\n") if x.startswith("own")] == [x for x in kept if x.startswith("own")]
        assert got[i]["removed_chars"] == len(rows[i - 1][1]) - len(got[i]["text"])


def test_line_dedup_equals_brute_force(spark):
    rows = some_docs(40)
    rows += [(100 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(rows[:10])]
    seen, want = set(), {}
    for i, text, *_ in sorted(rows):
        lines, kept = text.split("\n"), []
        for a, b, counts in line_dedup.chunks(text):
            piece = "\n".join(lines[a:b])
            if not counts or piece not in seen:
                kept += lines[a:b]
            if counts:
                seen.add(piece)
        want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == want


def test_colliding_chunks_are_told_apart(spark):
    cols = "no_id boolean, k_id long, th long, place int, h long, bytes binary"
    texts = spark.createDataFrame([(False, 1, 1, 0, 5, b"x"), (False, 2, 1, 0, 5, b"y"), (False, 3, 1, 0, 5, b"y")], cols)
    joined = texts.select("no_id", "k_id", "th")
    got = line_dedup._told_apart(joined, texts, texts.select("h").distinct(), ["no_id", "k_id", "th"]).collect()
    assert {r["k_id"]: r["also"] for r in got} == {1: [0], 2: [0], 3: None}


def test_every_line_of_a_repeated_passage_goes(spark):
    draw = random.Random(6)
    fresh = lambda: "own " + " ".join(str(draw.randrange(10**9)) for _ in range(6))
    rows, n = [], 0
    for size in (2, 3, 4, 6, 20):
        for _ in range(12):
            passage = [f"passage {n} line {i}" + "\n" * (draw.random() < 0.2) for i in range(size)]
            for _ in range(3):
                rows.append((len(rows), "\n".join([fresh(), *passage, fresh(), f"lone {n}", fresh()]), "en", "s", 0))
            n += 1
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows), passages=True).collect()}
    for i, text, *_ in rows:
        lines = [x for x in text.split("\n") if x]
        left = lines if i % 3 == 0 else [x for x in lines if not x.startswith("passage")]
        assert [x for x in got[i]["text"].split("\n") if x] == left
        assert got[i]["removed_chunks"] == (i % 3 > 0) and got[i]["removed_chars"] == len(text) - len(got[i]["text"])


def test_repeated_passages_equal_brute_force(spark):
    draw = random.Random(8)
    rows = [(i, "\n".join(draw.choice(["", "a b", "c", "d e", " ", "f", "g " * 50, "h"]) for _ in range(draw.randrange(1, 7))), "en", "s", 0) for i in range(150)] + [(900, "z z\nz z\nz z\nz z", "en", "s", 0)]
    seen, want = set(), {}
    for i, text, *_ in rows:
        lines, dead, here = text.split("\n"), set(), {}
        at = [k for k, x in enumerate(lines) if x.split()]
        units = sorted([(a, b, (lines[a], lines[b])) for a, b in zip(at, at[1:], strict=False)] + [(a, a, (lines[a],)) for a in at if len(lines[a].split()) >= 50])
        for a, b, x in units:
            if x in seen:
                dead.update(k for k in range(a, b + 1) if k not in here.get(x, ()))
            else:
                seen.add(x)
                here[x] = {a, b}
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in dead)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows), passages=True).collect()} == want
    assert want[900] == "z z\nz z"


# Quality classifier


def test_classifier_learns_and_is_repeatable(spark):
    good = [(i, t, "en", "s", 0) for i, t, *_ in some_docs(150, 7)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in t.split()), "en", "s", 0) for i, t, *_ in some_docs(150, 8)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad if r[0] % 3], "doc_id long, quality int")
    scores = []
    for _ in range(2):
        m = quality_classifier.fit(docs, labels)
        scores.append({r[0]: r[1] for r in docs.select("doc_id", quality_classifier.score(m, docs)).collect()})
    assert scores[0] == scores[1]
    held = [(i, s) for i, s in scores[0].items() if i % 3 == 0]
    assert np.mean([(s >= 0.5) == (i < 1000) for i, s in held]) > 0.95 and all(0 <= s <= 1 for _, s in held)


# Line rules


def brute_counts(text):
    words = WORDS.findall(text)
    spans = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if spans[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("text", ["", "a b c a b c", "x x x x x", "é# ü|\n\né# ü|\r\n a\x0bb c", *[r[1] for r in some_docs(30, 9)]])
def test_base_counts(text):
    got = line_rules._judged(line_rules.DEFAULT, text, 0.5)
    assert got[:5] == brute_counts(text)
    assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_viterbi_and_gradient_equal_brute_force():
    draw = np.random.Generator(np.random.PCG64(1))
    f = line_rules.Field(draw.normal(size=(2, len(line_rules.FEATURES))), draw.normal(size=(2, 2)))
    x = draw.normal(size=(7, len(line_rules.FEATURES)))
    value = lambda y: sum(x[t] @ f.labels[y[t]] for t in range(7)) + sum(f.steps[y[t - 1], y[t]] for t in range(1, 7))
    every = [[(n >> t) & 1 for t in range(7)] for n in range(128)]
    assert list(line_rules.viterbi(f, x)) == max(every, key=value)
    like = value([1] * 7) - np.logaddexp.reduce([value(y) for y in every])
    got, g_labels, g_steps = line_rules.gradient(f, [x], np.array([1]))
    assert math.isclose(got, like, rel_tol=1e-9)
    for at, g, part in (((1, 3), g_labels, "labels"), ((0, 1), g_steps, "steps")):
        moved = line_rules.Field(f.labels.copy(), f.steps.copy())
        getattr(moved, part)[at] += 1e-6
        assert math.isclose((line_rules.gradient(moved, [x], np.array([1]))[0] - got) / 1e-6, g[at], rel_tol=1e-3, abs_tol=1e-6)


# URL filters


def test_url_verdicts(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://org/", "http://x.org", "http://x.com/fr/9", "http://x.com/de/", "http://x.com/dex", "http://xcom/fr/", None, "no url", "http://example.org/es", "://b.example.org/en/1#f", "http://a.com/FR/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), url


# SimHash


def test_fingerprint_by_hand():
    def brute(text, k=3):
        w = [x for x in WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
        if not w:
            return 0
        s = [" ".join(w)] if len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ["", "One", "one Two", "É é A b C a b c", *[r[1] for r in some_docs(20)]]:
        assert simhash.simhash(text.encode()) == brute(text)


def test_links_and_components_equal_brute_force(spark):
    draw = random.Random(2)
    prints = set()
    for _ in range(40):
        x = draw.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            x ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
            prints.add(x)
    prints = sorted(simhash._signed(x) for x in prints)
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    stars = components(spark.createDataFrame(sorted(want), "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in stars} == {p: r for p, r in root.items() if p != r}


def test_one_of_each_group_stays(spark):
    rows = [(5, "same text here now", "en", "s", 0), (3, "Same TEXT here now", "en", "s", 0), (3, "Same TEXT here now", "en", "s", 0), (None, "same text here now", "en", "s", 0), (7, "another thing at all", "en", "s", 0)]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == [3, 7]
    nulls = [(None, t, "en", "s", 0) for t in ("a b c", "a b c", "q w e r")]
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(frame(spark, nulls)).collect()) == ["a b c", "q w e r"]


def test_components_that_share_an_id_each_keep_a_row(spark):
    rows = [(1, "same text here now", "en", "s", 0), (1, "another thing at all", "en", "s", 0), (5, "same text here now", "en", "s", 0), (6, "another thing at all", "en", "s", 0)]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == [(1, "another thing at all"), (1, "same text here now")]
    words = [f"w{i}" for i in range(400)]
    edits = [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(400)]
    near = next(t for t in edits if 0 < (simhash.simhash(t.encode()) ^ simhash.simhash(" ".join(words).encode())).bit_count() <= 2)
    nulls = [(None, t, "en", "s", 0) for t in (" ".join(words), near, "q w e r")]
    assert simhash.drop_near_duplicates(frame(spark, nulls)).count() == 2


# SentencePiece


def test_codec_agrees_with_the_library_and_round_trips():
    with open(PIECES, "rb") as f:
        raw = f.read()
    codec, own = sentencepiece_codec.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["", "a", " a", "a ", "a  b", "\n\n", "   " * 30 + "x", "tab\there", "漢字🙂é", "<s> </s>", "x" * 3000, "a" + " " * 37 + "b", "\x00\x01", *[r[1] for r in some_docs(20)]]
    for text, (ids, same) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == own.encode(text) and same and codec.decode(ids.tolist()) == text


def test_unigram_model_is_rebuilt():
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + value

    def piece(text, score, kind=1):
        b = text.encode()
        body = field(1, 2, bytes([len(b)]) + b) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0, 2), *[(f"<0x{i:02X}>", -20, 6) for i in range(256)], ("▁a", -1, 1), ("b", -2, 1), ("ab", -2.5, 1), ("▁", -3, 1), ("a", -4, 1), ("c", -5, 1), ("bc", -6, 1)]
    trainer = field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 >> 4]) + b"\x01"
    norm = field(1, 2, b"\x08identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00")
    raw = b"".join(piece(*p) for p in pieces) + field(2, 2, bytes([len(trainer)]) + trainer) + field(3, 2, bytes([len(norm)]) + norm)
    model = sentencepiece_codec.parse(raw)
    assert model.algorithm == 1 and model.byte_fallback and not model.trim
    codec, own = sentencepiece_codec.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ["a b c", "abc abc", "aabbcc", "é a", "ab  bc"]:
        assert codec.encode([text])[0][0].tolist() == own.encode(text)


def test_decode_frame(spark):
    coded = sentencepiece_codec.encode(frame(spark, some_docs(10)), PIECES)
    for r in sentencepiece_codec.decode(coded, PIECES).collect():
        assert r["decoded"] == r["text"] and r["parity"] and r["round_trip"]


# HTML


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=ad-1>Buy</div><aside>Side</aside><form><p>Mail <input></form>%s<section class="comments"><p>Nice post!</p></section><footer>&copy; me</footer></body></html>"""
ARTICLE = "<article><h1>Head &amp; more</h1><p>One  two\n three<p><b>Four<br>five</b></p><div class=related>More</div><p>&lt;x&gt; &#233;</p></article>"
TEXT = "Head & more\nOne two three\nFour\nfive\n<x> é"


def test_main_text_and_consensus(spark):
    other = "<div class='post-12'><p>" + "long body text here. " * 20 + "</p></div>"
    rows = [(1, "http://h/1", PAGE % ARTICLE), (2, "http://h/2", PAGE % ARTICLE), (3, "http://g/1", PAGE % other), (4, "http://h/3", PAGE % other), (5, None, None), (6, "http://h/4", ""), (7, "http://z/", "just <b>text</b> & more"), (8, "http://y/", "<p>a < b <unclosed 'quote")]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == got[2]["text"] == TEXT and got[1]["n_chars"] == len(TEXT)
    assert got[3]["text"] == got[4]["text"] == ("long body text here. " * 20).strip()
    assert got[3]["path"].endswith("div.post-#") and got[5]["text"] == got[6]["text"] == "" and got[7]["text"] == "just text & more" and got[8]["text"].startswith("a < b")


def test_unclosed_elements():
    page = "<head><title>T</title><body><nav><ul><li>Home<li>About<article><p>One<p>Two<div class=ad>Buy</div></article><footer>end"
    assert html_extraction.main_text(page, None)[0] == "One\nTwo"


@pytest.mark.parametrize(("name", "bad"), [("main-content", False), ("content with-sidebar", False), ("article-comments", True), ("ad-slot-3", True), ("mainNav", True), ("header", True), ("adventure", False), ("post-body", False), ("cookie_notice", True), ("shadow", False)])
def test_names_of_boilerplate(name, bad):
    assert any(map(html_extraction._bad_name, name.split())) == bad


# Mixing


def test_targets_fill_like_water(spark):
    rows = [(i, " ".join(["w"] * n), "en", s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 400), ("c", 300), (None, 90), ("é", 500)] * 3)]
    got = {r["sk"] if not r["no_source"] else None: r["target"] for r in mixing.targets(mixing.sizes(frame(spark, rows))).collect()}
    size = {"a": 30, "b": 1200, "c": 900, "é": 1500, None: 270}
    weight = dict(zip(["a", "b", "c", "é", None], [3, 1, 2, 3, 1], strict=True))
    left, open_, want = 1.5 * sum(size.values()), set(size), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            open_.remove(s)
    want |= {s: level * weight[s] for s in open_}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)
    planned = mixing.plan(frame(spark, rows))
    first = {(r["id"], r["size"] * r["times"]) for r in mixing.taken(planned, mixing.draw(planned, block_words=64)).collect()}
    assert first == {(r["id"], r["size"] * r["times"]) for r in mixing.taken(planned, mixing.draw(planned, block_words=64)).collect()}
    by = Counter()
    for i, t in first:
        by[rows[i][3]] += t
        assert t <= 2 * len(rows[i][1].split())
    largest = {s: max(len(r[1].split()) for r in rows if r[3] == s) for s in size}
    assert all(abs(by[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)


def test_mix_uses_no_python(spark):
    planned = mixing.plan(frame(spark, some_docs(10)))
    text = mixing.draw(planned)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text


# Top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 90)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 7)
    draw = np.random.Generator(np.random.PCG64(4))
    x = draw.normal(size=(400, 8)).astype(np.float32)
    x[200:300] = x[:100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 400, 20):
        s = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        want |= {(q, r + 1, i, int(s[i])) for r, i in enumerate(best)}
    assert {tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 20 == 0).collect()} == want


def test_elimination_spares_evaluations(monkeypatch):
    draw = np.random.Generator(np.random.PCG64(6))
    centres = draw.integers(-400, 400, (20, 4))
    x = (centres[draw.integers(0, 20, 5000)] + draw.integers(-5, 6, (5000, 4))).astype(np.int64)
    far = np.sqrt(((x[:, None] - x[None, :16]) ** 2).sum(axis=2).astype(float))
    done = []
    real = exact_topk._products
    monkeypatch.setattr(exact_topk, "_products", lambda a, b: done.append(len(a)) or real(a, b))
    ids = np.arange(5000)
    q, i, s = exact_topk.search_block(ids[:10], x[:10], far[:10], ids, x, far, 5)
    for n in range(10):
        p = x @ x[n]
        best = sorted((j for j in range(5000) if j != n), key=lambda j: (-p[j], j))[:5]
        assert i[q == n].tolist() == best
    assert sum(done) < 10 * 5000 / 2


# Language model


def test_lm_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUNDLE_CHARS", 900)
    monkeypatch.setattr(ngram_lm, "RANGE_CHARS", 1500)
    rows = [*some_docs(50), (None, "The of1 unseen", "en", "s", 0), (777, None, "en", "s", 0), (778, "", "en", "s", 0)]
    got = ngram_lm.score(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: [*WORDS.findall((t or "").lower()), None]
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = toks(t)
            one.update(w)
            two.update(zip(["<start>", *w], w, strict=False))
    n, v, starts = sum(one.values()), len(one), sum(not held(r[0]) for r in rows)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        w = toks(texts[r["id"]])
        c = lambda h: starts if h == "<start>" else one[h]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["id"]), len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(p(x)) for x in w), rel_tol=1e-9)
        chain = sum(math.log10((two[h, x] + ngram_lm.MASS * p(x)) / (c(h) + ngram_lm.MASS)) for h, x in zip(["<start>", *w], w, strict=False))
        assert math.isclose(r["score"], chain, rel_tol=1e-9)
