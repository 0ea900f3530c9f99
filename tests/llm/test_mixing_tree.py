"""The splitting tree against a plain version of the whole draw, its distribution, and what it changes."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("n", "k", "d"), [(20, 7, 10), (50, 1, 25), (9, 9, 4), (10, 0, 5), (400, 130, 200), (7, 3, 0), (1, 1, 1), (6, 5, 3)])
def test_draws_follow_the_distribution(spark, n, k, d):
    us = [(i + 0.5) / 4000 for i in range(4000)]
    long = lambda x: F.lit(x).cast("long")
    got = Counter(r["v"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.hypergeometric(long(n), long(k), long(d), F.col("u")).alias("v")).collect())
    want = {v: math.comb(k, v) * math.comb(n - k, d - v) / math.comb(n, d) for v in range(max(0, d - (n - k)), min(k, d) + 1)}
    assert set(got) <= set(want) and all(abs(got[v] / 4000 - p) < 1e-3 for v, p in want.items())


def test_draws_of_large_urns_keep_their_mean(spark):
    long = lambda x: F.lit(x).cast("long")
    us = [(i + 0.5) / 200 for i in range(200)]
    got = [r["v"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.hypergeometric(long(10**6), long(3 * 10**5), long(5 * 10**5), F.col("u")).alias("v")).collect()]
    mean, sd = 150_000, math.sqrt(5e5 * 0.3 * 0.7 * 5e5 / (1e6 - 1))
    assert abs(sum(got) / 200 - mean) < 3 and abs(math.sqrt(sum((x - mean) ** 2 for x in got) / 200) / sd - 1) < 0.02 and got == sorted(got)


def uniform(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / float(16**13)


def hypergeometric(n, k, d, u):
    """By adding up the weights of all values."""
    low, high = max(0, d - (n - k)), min(k, d)
    mode = min(high, max(low, int((d + 1) * (k + 1) // (n + 2))))
    weight = {mode: 1.0}
    for i in range(mode, low, -1):
        weight[i - 1] = weight[i] * (i * (n - k - d + i) / ((k - i + 1) * (d - i + 1)))
    for i in range(mode, high):
        weight[i + 1] = weight[i] * ((k - i) * (d - i) / ((i + 1) * (n - k - d + i + 1)))
    goal, seen = u * sum(weight.values()), 0.0
    for i in range(low, high + 1):
        seen += weight[i]
        if seen > goal:
            return i
    return high


def plain_split(urn, depth, seed):
    """Leaves {(pass key, shard): (first, length, quota)} of an urn {pass key: (blocks, quota)}."""
    nodes = {0: {key: (0, n, q) for key, (n, q) in urn.items()}}
    for level in range(depth):
        below = {}
        for node, runs in nodes.items():
            balls = sum(q for _, _, q in runs.values())
            draws = balls // 2
            for key in sorted(runs, key=lambda k: (k[0], k[1].encode(), k[2])):
                first, length, quota = runs[key]
                left = hypergeometric(balls, quota, draws, uniform(seed, str(level), str(node), str(key[0]).lower(), key[1], str(key[2])))
                balls, draws = balls - quota, draws - left
                mine = left + (length - quota) // 2
                below.setdefault(2 * node, {})[key] = (first, mine, left)
                below.setdefault(2 * node + 1, {})[key] = (first + mine, length - mine, quota - left)
        nodes = {n: {k: r for k, r in runs.items() if r[1]} for n, runs in below.items()}
    return {(k, n): r for n, runs in nodes.items() for k, r in runs.items()}


def plain_draw(planned, block_words, depth, seed):
    """{(id, pass): shard} from the plan's rows."""
    sources = {(r["no_source"], r["sk"]): (r["source_size"], r["target"]) for r in planned}
    urn, rest = {}, {}
    for s, (size, target) in sources.items():
        for p in range(2):
            wanted = max(0.0, min(float(size), target - p * size))
            if size and wanted > 0:
                n = -(-size // block_words)
                urn[*s, p] = (n, n if wanted >= size else math.ceil(wanted / block_words))
                rest[*s, p] = wanted
    leaves = plain_split(urn, depth, seed)
    out = {}
    for key, (n, quota) in urn.items():
        turn, owner, done = {}, {}, 0
        spare = quota
        for shard in range(1 << depth):
            first, length, q = leaves.get((key, shard), (0, 0, 0))
            for i in range(length):
                owner[first + i] = shard
                if i < q:
                    turn[first + i], done = done, done + 1
                else:
                    turn[first + i], spare = spare, spare + 1
        assert sorted(turn.values()) == sorted(owner) == list(range(n))
        rows = [(min((2 * r["start"] + r["size"]) // (2 * block_words), n - 1), r) for r in planned if (r["no_source"], r["sk"]) == key[:2] and r["size"]]
        before = 0
        for b, r in sorted(rows, key=lambda x: (turn[x[0]], x[1]["start"])):
            if quota == n or before + r["size"] / 2 <= rest[key]:
                out[r["id"], key[2]] = owner[b]
            before += r["size"]
    return out


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(6)
    return [(i, " ".join(["w"] * draw.choice([0, 1, 5, 40, 40, 300])), "en", draw.choice(["big", "big", "big", "a", "é", None]), 0) for i in range(400)]


@pytest.mark.parametrize(("block_words", "shard_words"), [(64, 2000), (16, 400), (1000, 10**9)])
def test_draw_equals_a_plain_version(spark, docs, block_words, shard_words):
    planned = mixing.plan(spark.createDataFrame(docs, SCHEMA))
    rows = planned.collect()
    drawn = mixing.draw(planned, block_words=block_words, shard_words=shard_words).collect()
    total = sum({(r["no_source"], r["sk"]): r["target"] for r in rows}.values())
    depth = max(0, int(total // shard_words)).bit_length()
    assert {(r["id"], r["pass"]): r["shard"] for r in drawn} == plain_draw(rows, block_words, depth, "mix") and len(drawn) == len({(r["id"], r["pass"]) for r in drawn})
    # Every shard has its own order, from 1 on.
    for shard in {r["shard"] for r in drawn}:
        assert sorted(r["position"] for r in drawn if r["shard"] == shard) == list(range(1, 1 + sum(r["shard"] == shard for r in drawn)))
    size, words = {}, Counter()
    for r in rows:
        size[r["sk"]] = max(size.get(r["sk"], 0), r["size"])
    for r in drawn:
        words[r["sk"]] += r["size"]
    assert all(abs(words[r["sk"]] - r["target"]) <= size[r["sk"]] / 2 + 1e-6 for r in rows)


def test_the_tree_decides_what_is_drawn(spark, docs):
    planned = mixing.plan(spark.createDataFrame(docs, SCHEMA))
    found = [{(r["id"], r["pass"]) for r in mixing.draw(planned, block_words=64, shard_words=w, seed=s).collect()} for w, s in ((2000, "mix"), (2000, "other"), (10**9, "mix"), (2000, "mix"))]
    assert found[0] == found[3] and found[0] != found[1] and found[0] != found[2]
    text = mixing.taken(planned, mixing.draw(planned, block_words=64, shard_words=2000))._jdf.queryExecution().optimizedPlan().toString()
    assert "turn" in text and "Python" not in text


def test_mixed_documents_are_the_drawn_rows(spark, docs):
    twice = docs + docs[:5] * 2
    df = spark.createDataFrame(twice, SCHEMA)
    want = Counter(r["id"] for r in mixing.draw(mixing.plan(df)).collect())
    got = mixing.mix_documents(df)
    assert got.columns == df.columns and Counter(r["doc_id"] for r in got.collect()) == want


def test_texts_move_to_their_draws_and_to_their_shards_only(spark, docs):
    mixed = mixing.mix_documents(spark.createDataFrame(docs, SCHEMA))
    plan = mixed._sc._jvm.PythonSQLUtils.explainString(mixed._jdf.queryExecution(), "formatted")
    moved = [x for x in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan) if re.search(r"\b(row|text)#", x)]
    assert len(moved) == 2


def test_rows_of_two_sources_take_their_own_draws(spark, docs):
    both = [r for r in docs if r[3] == "big"]
    df = spark.createDataFrame(both + [(*r[:3], "é", r[4]) for r in both] + [(*r[:3], None, r[4]) for r in both], SCHEMA)
    want = Counter((r["id"], r["source"]) for r in mixing.draw(mixing.plan(df)).collect())
    assert Counter((r["doc_id"], r["source"]) for r in mixing.mix_documents(df).collect()) == want and len({s for _, s in want}) == 3


def test_copies_in_several_arrays(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    copies = [(7, "a b c", "en", "a", i) for i in range(30)] + docs[:40]
    df = spark.createDataFrame(copies, SCHEMA)
    want = Counter(r["id"] for r in mixing.draw(mixing.plan(df)).collect())
    got = mixing.mix_documents(df).collect()
    used = Counter(r["n_chars"] for r in got if r["doc_id"] == 7 and r["text"] == "a b c")
    assert Counter(r["doc_id"] for r in got) == want and max(used.values()) <= 2 and len(used) > 8
