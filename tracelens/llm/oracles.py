"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from tracelens.llm import ngram_lm

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(host, path, verdict) AS (VALUES {values}),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT n, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (n)
"""


TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: CRC-32 of the ids is folded byte by byte, as DuckDB has no function for it.
LANGUAGE_MODEL = f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256))::UBIGINT AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT i, c FROM bits WHERE k = 8),
folded(doc_id, s, k, c) AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT f.doc_id, s, k + 1, xor(f.c // 256, t.c) FROM folded f JOIN crc_table t ON t.i = xor(f.c, ascii(s[k + 1])::UBIGINT) % 256 WHERE k < length(s)),
held AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 10 = 0 AS held_out FROM folded WHERE k = length(s)),
d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
docs AS (SELECT n, d.doc_id, coalesce(held_out, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}'), '') AS w FROM d LEFT JOIN held ON held.doc_id = d.doc_id),
tok AS (SELECT n, held_out, unnest(w) AS w, unnest(list_prepend(' start', w[:-2])) AS h FROM docs),
one AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY 1),
two AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY 1, 2),
state AS (SELECT w AS h, c FROM one UNION ALL SELECT ' start', (SELECT count(*) FROM docs WHERE NOT held_out)),
model AS (SELECT coalesce(sum(c), 0)::DOUBLE AS total, count(*)::DOUBLE AS v FROM one),
p AS (SELECT n, coalesce(one.c, 0) AS c, coalesce(two.c, 0) AS c2, coalesce(state.c, 0) AS ch, (coalesce(one.c, 0) + {ngram_lm.ADD}::DOUBLE) / (total + {ngram_lm.ADD}::DOUBLE * (v + 1)) AS p
  FROM tok CROSS JOIN model LEFT JOIN one ON one.w = tok.w LEFT JOIN two ON two.h = tok.h AND two.w = tok.w LEFT JOIN state ON state.h = tok.h),
s AS (SELECT n, count(*) AS n_tokens, count_if(c > 0) AS n_known, round(sum(log10(p)), 6) AS base_score, round(sum(log10((c2 + {ngram_lm.MASS}::DOUBLE * p) / (ch + {ngram_lm.MASS}::DOUBLE))), 6) AS score FROM p GROUP BY n)
SELECT doc_id, held_out, n_tokens, n_known, CAST((SELECT total FROM model) AS BIGINT) AS train_tokens, base_score, score FROM docs JOIN s USING (n)
"""


_CRC_TABLE = """bits(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256))::UBIGINT AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT i, c FROM bits WHERE k = 8)"""


def _merkle(depth: int = 7, source_depth: int = 4) -> str:
    """Levels are spelt out: up to 16 ** depth rows a source and 16 ** source_depth sources."""
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = [framed(c) for c in ("doc_id", "source", "lang", "n_chars")]
    folded_text = framed(f"translate(text, '{_UPPER}', '{_LOWER}')")

    def tree(v: str, levels: int) -> str:
        """Nodes v0 to v<levels>, and what stands left and right of each."""
        up = [f"{v}{k} AS (SELECT s, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (m + 15) // 16 AS m FROM {v}{k - 1} WHERE m > 1 GROUP BY s, i // 16, m)" for k in range(1, levels + 1)]
        beside = [
            f"{v}w{k} AS (SELECT a.s, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {v}{k} a JOIN {v}{k} b ON a.s = b.s AND a.i // 16 = b.i // 16 WHERE a.m > 1 GROUP BY a.s, a.i)"
            for k in range(levels)
        ]
        return ", ".join(up + beside)

    top = lambda v, levels: " UNION ALL ".join(f"SELECT s, d FROM {v}{k} WHERE m = 1" for k in range(levels + 1))
    steps = [(f"a{k}", f"vw{k}", "x.s", f"x.p // {16**k}") for k in range(depth)] + [(f"b{k}", f"uw{k}", "0", f"x.s // {16**k}") for k in range(source_depth)]
    joins = " ".join(f"LEFT JOIN {w} {a} ON {a}.s = {s} AND {a}.i = {i}" for a, w, s, i in steps)
    sides = ", ".join(f"{a}.l AS l_{a}, {a}.r AS r_{a}" for a, *_ in steps)
    chain, at = [], "joined"
    for a, *_ in steps:
        chain.append(f"f_{a} AS (SELECT * REPLACE (CASE WHEN l_{a} IS NULL THEN folded ELSE sha256(l_{a} || folded || r_{a}) END AS folded) FROM {at})")
        at = f"f_{a}"
    proof = " || ".join(f"coalesce(l_{a} || r_{a}, '')" for a, *_ in steps)
    return f"""
WITH RECURSIVE {_CRC_TABLE},
folded(doc_id, s, k, c) AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT f.doc_id, s, k + 1, xor(f.c // 256, t.c) FROM folded f JOIN crc_table t ON t.i = xor(f.c, ascii(s[k + 1])::UBIGINT) % 256 WHERE k < length(s)),
picked AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 5 = 0 AS p FROM folded WHERE k = length(s)),
h AS (SELECT d.doc_id, source, sha256({' || '.join([*fields, framed('text')]).replace('(doc_id', '(d.doc_id')}) AS leaf, CASE WHEN coalesce(p, false) THEN sha256({' || '.join([*fields, folded_text]).replace('(doc_id', '(d.doc_id')}) END AS changed FROM documents d LEFT JOIN picked ON picked.doc_id = d.doc_id),
x AS (SELECT doc_id, leaf, coalesce(changed, leaf) AS folded, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf, coalesce(changed, leaf)) - 1 AS p, count(*) OVER (PARTITION BY source) AS m FROM h),
v0 AS (SELECT s, p AS i, leaf AS d, m FROM x),
{tree("v", depth)},
subroots AS ({top("v", depth)}),
u0 AS (SELECT 0 AS s, s AS i, d, count(*) OVER () AS m FROM subroots),
{tree("u", source_depth)},
roots AS ({top("u", source_depth)}),
joined AS (SELECT x.doc_id, x.leaf, x.folded, x.s, {sides} FROM x {joins}),
{', '.join(chain)}
SELECT doc_id, leaf, subroots.d AS subroot, roots.d AS root, sha256({proof}) AS proof_sha256, folded AS folded_root, folded = roots.d AS verified FROM {at} t JOIN subroots ON subroots.s = t.s CROSS JOIN roots
"""


MERKLE = _merkle()

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS doc, translate(w, '{_UPPER}', '{_LOWER}') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')) AS w FROM documents) GROUP BY 1, 2),
keyed AS (SELECT w, n, row_number() OVER () AS id, hex(encode(doc || ':' || w)) AS x FROM runs),
crc(id, x, k, c) AS (SELECT id, x, 0, 4294967295::UBIGINT FROM keyed
  UNION ALL SELECT f.id, x, k + 2, xor(f.c // 256, t.c) FROM crc f JOIN crc_table t ON t.i = xor(f.c, (16 * (instr('0123456789ABCDEF', x[k + 1]) - 1) + instr('0123456789ABCDEF', x[k + 2]) - 1)::UBIGINT) % 256 WHERE k < length(x)),
hashed AS (SELECT id, xor(c, 4294967295::UBIGINT) AS h FROM crc WHERE k = length(x)),
spelt AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM keyed JOIN hashed USING (id)),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
shorter AS (SELECT DISTINCT c.word AS a, c.n AS an, v.word AS b, v.n AS bn FROM cuts c JOIN v ON v.word = c.d),
near AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS b FROM near GROUP BY 1),
known AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN b END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
reach(word, last, k) AS (SELECT word, word, 0 FROM known UNION ALL SELECT r.word, form, k + 1 FROM reach r JOIN known ON known.word = r.last WHERE form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, k) FROM reach r WHERE r.word = known.word) AS root, n, n_near, form_n FROM known
"""
