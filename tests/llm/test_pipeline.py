"""The pipeline's rows against a plain, single-machine version of its stages."""

import hashlib
import random
import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from tracelens.llm import line_dedup, quality_classifier, simhash
from tracelens.llm.common import crc32_mod
from tracelens.llm.queries import PIECES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in "the of and to in is that for".split() for b in "abcdefghij"]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(draw.randrange(4, 30)) for _ in range(draw.randrange(2, 9))), "en", f"s{i % 5}") for i in range(200)]
    rows += [(1000 + i, re.sub(r"(\w+)", lambda m: m[1].upper() + "!!", line(80)), "en", "s0") for i in range(60)]
    rows += [(2000 + i, rows[i][1], "en", "s1") for i in range(20)]  # exact copies
    rows += [(3000 + i, rows[i][1] + "\n" + line(6), "en", None) for i in range(20)]  # longer copies
    rows += [(4000, "", "en", "s2"), (4001, "", "en", "s3")]
    return [(*r, len(r[1])) for r in rows]


def deduped(rows):
    seen, out = set(), []
    for r in sorted(rows):
        lines, kept = r[1].split("\n"), []
        for a, b, counts in line_dedup.chunks(r[1]):
            piece = "\n".join(lines[a:b])
            if not counts or piece not in seen:
                kept += lines[a:b]
            if counts:
                seen.add(piece)
        out.append((r[0], "\n".join(kept), *r[2:4], len("\n".join(kept))))
    return out


def one_of_each(rows):
    prints = [simhash.simhash(r[1].encode()) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {}
    for r, x in zip(rows, root, strict=True):
        least[x] = min(least.get(x, r[0]), r[0])
    return [r for r, x in zip(rows, root, strict=True) if r[0] == least[x]]


def mixed(rows):
    size = {r: len(WORD.findall(r[1])) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r] for r in by[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, want = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * total[s]]
        for s in full or list(free):
            want[s] = 2 * total[s] if full else level * weight[s]
            left -= want[s]
            free.discard(s)
    out = Counter()
    md5 = lambda b: hashlib.md5(b).hexdigest()
    for s in names:
        start = 0
        for r in sorted(by[s], key=lambda r: md5(f"mix|{r[0]}|{md5(r[1].encode())}".encode())):
            for again in range(2):
                if size[r] and again * total[s] + start + size[r] / 2 <= want[s]:
                    out[r] += 1
            start += size[r]
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(not 1000 <= r[0] < 2000), 0) for r in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality_classifier.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels.where(crc32_mod("doc_id", 3) != 1))
    scores = model.score(quality_classifier.pool([r[1] for r in rows], quality_classifier.word_vectors(model.context), quality_classifier.Buckets()))
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    assert not any(1000 <= r[0] < 2000 for r in kept) and len(kept) > 200
    want = mixed(one_of_each(deduped(kept)))
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = Counter()
    for r, n in want.items():
        expected[(r[0], r[3], tuple(own.encode(r[1])))] += n
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in got) == expected
    assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
