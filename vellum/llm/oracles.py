"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vellum.llm.quality_rules import (
    AGAINST_BAD,
    AGAINST_GOOD,
    GOOD_SHARE,
    ITERATIONS,
    MAX_REPEAT_PERCENT,
    MIN_WORDS,
    ON_BAD,
    ON_GOOD,
    PRIOR_ROWS,
    RULES,
    SHARE_RANGE,
)

_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, (common.key IS NOT NULL AND doc_id <> keep) AS gone FROM k LEFT JOIN common ON k.key = common.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _quality() -> str:
    value = {
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "chars_per_word": "word_chars / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
        "marks_per_word": "n_marks / greatest(n_words, 1)",
    }
    cases = []
    for j, (of, side, bad, good) in enumerate(RULES.values()):
        v, lo, hi = value[of], *(("<", ">=") if side == "low" else (">", "<="))
        cases.append(f"CASE WHEN n_words = 0 THEN 0 WHEN {v} {lo} {bad} THEN -1 WHEN {v} {hi} {good} THEN 1 ELSE 0 END AS v{j}")
    n, votes = len(RULES), {-1: "m", 0: "z", 1: "p"}
    vs = ", ".join(f"v{j}" for j in range(n))
    ratio = lambda e, j: f"CASE v{j} " + " ".join(f"WHEN {k} THEN ln({e}.g{x}{j} / {e}.b{x}{j})" for k, x in votes.items()) + " END"
    score = lambda e: f"1 / (1 + exp(-(ln({e}.pi / (1 - {e}.pi)) + " + " + ".join(ratio(e, j) for j in range(n)) + ")))"
    start = [f"{on[k + 1]}::DOUBLE AS {c}{x}{j}" for j in range(n) for c, on in (("g", ON_GOOD), ("b", ON_BAD)) for k, x in votes.items()]
    steps = [f"em0 AS MATERIALIZED (SELECT {GOOD_SHARE}::DOUBLE AS pi, {', '.join(start)})"]
    for i in range(ITERATIONS):
        pi = f"least({SHARE_RANGE[1]}, greatest({SHARE_RANGE[0]}, (sum(g) + {PRIOR_ROWS * GOOD_SHARE}) / (sum(n) + {PRIOR_ROWS}))) AS pi"
        chances = [
            f"(sum(CASE WHEN v{j} = {k} THEN {of} ELSE 0 END) + {PRIOR_ROWS * on[k + 1]}) / (sum({of}) + {PRIOR_ROWS}) AS {c}{x}{j}"
            for j in range(n)
            for c, of, on in (("g", "g", ON_GOOD), ("b", "n - g", ON_BAD))
            for k, x in votes.items()
        ]
        bound = lambda c, j: f"least({(AGAINST_GOOD if c == 'g' else AGAINST_BAD)[1]}, greatest({(AGAINST_GOOD if c == 'g' else AGAINST_BAD)[0]}, {c}m{j}))"
        held = [
            f"{bound(c, j)} AS {c}m{j}, {c}z{j} * (1 - {bound(c, j)}) / ({c}z{j} + {c}p{j}) AS {c}z{j}, {c}p{j} * (1 - {bound(c, j)}) / ({c}z{j} + {c}p{j}) AS {c}p{j}"
            for j in range(n)
            for c in "gb"
        ]
        steps.append(f"raw{i + 1} AS MATERIALIZED (SELECT {pi}, {', '.join(chances)} FROM (SELECT p.*, n * {score('e')} AS g FROM patterns p, em{i} e))")
        steps.append(f"em{i + 1} AS MATERIALIZED (SELECT pi, {', '.join(held)} FROM raw{i + 1})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) t(o) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, {_WS}) <> '' GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_marks
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(cases)} FROM f),
patterns AS MATERIALIZED (SELECT {vs}, sum(CASE WHEN n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words THEN 0 ELSE 1 END)::DOUBLE AS n FROM v GROUP BY {vs}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  CASE WHEN n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words THEN false ELSE {score('e')} >= 0.5 END AS kept
FROM v, em{ITERATIONS} e
"""


MIXING = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM c) * 1.0::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * n) AS rate FROM c),
m AS (SELECT source, greatest(1, ceil(rate / 32))::INTEGER AS draws, rate / greatest(1, ceil(rate / 32)) AS mean FROM r),
p AS (
  SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM m
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM p WHERE k < 128
),
u AS (
  SELECT d.doc_id, d.source, j,
    ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.draws + 1)) AS t(j)
),
n AS (SELECT doc_id, count(*) FILTER (WHERE p.cdf <= u.u) AS n_copies FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY doc_id)
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, copy, n_copies,
  md5('mix|order|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key
FROM documents d JOIN n USING (doc_id), unnest(range(1, n_copies + 1)) AS t(copy)
"""

SHARDING = """
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n::BIGINT AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
s AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
x AS (
  SELECT doc_id, size, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c
  FROM s, crc
), o AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM x),
h AS (SELECT doc_id, size::BIGINT AS size, xor(c, 4294967295)::BIGINT AS text_crc32, ((start::HUGEINT * 24) // total)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM h
"""

NGRAMS = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (
  SELECT doc_id, n, i, word || chr(32) || lead(word) OVER o || chr(32) || lead(word, 2) OVER o || chr(32) || lead(word, 3) OVER o || chr(32) || lead(word, 4) OVER o AS s FROM p
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sh AS (
  SELECT DISTINCT doc_id, s FROM g WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT vec_id, min(other) AS m FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id FROM v LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id))
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""

SQL = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_quality_rules": _quality(),
    "op4_mixing": MIXING,
    "op6_sharding": SHARDING,
    "op7_ngram_join": NGRAMS,
    "op8_embedding_dedup": EMBEDDINGS,
}
