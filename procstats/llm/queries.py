"""The operators bound to the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, bpe, cover, lines, mixing, quality, quantised, simhash, suffix, tokens, toxicity, urls, whitening

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The ranks of byte_bpe_50k.json, and the pieces they are aligned with.
RANKS_A, MODEL_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels"))).drop("text")


def op4_quantised(spark, folder):
    return quantised.near_vectors(table(spark, folder, "embeddings"))


def op5_simhash(spark, folder):
    return simhash.report(table(spark, folder, "documents"))


def op6_token_counts(spark, folder):
    lengths = tokens.histogram(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return tokens.context_table(lengths)


def op7_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark, folder):
    return suffix.report(table(spark, folder, "documents"))


def op9_cover_dedup(spark, folder):
    return cover.report(table(spark, folder, "documents"))


def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, folder, "labels"))).drop("text")


def op11_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_line_dedup(spark, folder):
    return lines.report(table(spark, folder, "documents"))


def op13_alignment(spark, folder):
    path = public_tokenizers.path
    return alignment.align(table(spark, folder, "documents"), path(RANKS_A), public_tokenizers.PATTERN, path(MODEL_B))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_mixing, op3_line_quality, op4_quantised, op5_simhash, op6_token_counts, op7_url_filter,
                                   op8_suffix_dedup, op9_cover_dedup, op10_toxicity, op11_whitening, op12_line_dedup, op13_alignment, pipeline)}
W = mixing.WORD


def _mixing_sql() -> str:
    """The mix in SQL: same integers, same order, so the same blocks."""
    m, rounds = mixing, ""
    for k in range(m.ROUNDS):
        key = f"(((number * 104729 + turn * 1299709 + {7919 * (1 + k)}) % {m.P1}) * {m.A1} + 12345) % {m.P1}"
        bit = f"((((greatest(x, p) % {m.P1}) * {m.A1 + 7919 * k} + k) % {m.P1}) // 64) % 2"
        rounds += (f", p{k} AS (SELECT number, turn, blocks, x, (({key}) % blocks + blocks - x) % blocks AS p, {key} AS k FROM s{k})"
                   f", s{k + 1} AS (SELECT number, turn, blocks, CASE WHEN {bit} = 0 THEN p ELSE x END AS x FROM p{k})")
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM z),
v AS (SELECT *, [5, 2, 1][number % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM w),
u AS (SELECT *, most / weight AS ratio FROM v),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM u),
f AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, number LIMIT 1) AS level),
t AS (SELECT l.source, number, source_size, least(most, f.level * weight) AS target FROM l, f),
n AS (SELECT *, (source_size + {m.BLOCK - 1}) // {m.BLOCK} AS blocks FROM t WHERE source_size > 0),
c AS (SELECT *, target * blocks / source_size AS wanted FROM n),
e AS (SELECT *, sum(wanted) OVER () AS total FROM c),
g AS (SELECT number, blocks, wanted / total AS chance, round(total)::BIGINT AS slots FROM e),
h AS (SELECT DISTINCT number, blocks, chance, slots, unnest([{m.SHARD}, slots % {m.SHARD}]) AS length FROM g),
i AS (SELECT *, floor(chance * length)::BIGINT AS whole, chance * length - floor(chance * length) AS rest FROM h WHERE length > 0),
j AS (SELECT *, sum(rest) OVER (PARTITION BY length ORDER BY number ROWS UNBOUNDED PRECEDING) AS upto, (length - sum(whole) OVER (PARTITION BY length))::BIGINT AS remain,
  max(number) OVER (PARTITION BY length) AS last FROM i),
k AS (SELECT *, upto - rest AS start, max(upto) OVER (PARTITION BY length) AS span FROM j),
per AS (SELECT length, max(slots) AS slots, max(remain) AS remain FROM k GROUP BY 1),
sh AS (SELECT length, remain, unnest(CASE WHEN length = {m.SHARD} THEN range(slots // {m.SHARD}) ELSE [slots // {m.SHARD}] END) AS shard FROM per),
dr AS (SELECT length, shard, ({m.scramble("shard * 8191 + draw", "6")} + 0.5) / {m.P2} AS u FROM (SELECT length, shard, unnest(range(1, remain + 1)) AS draw FROM sh)),
hit AS (SELECT shard, number, count(*) AS extra FROM dr JOIN k USING (length) WHERE u * span >= start AND (u * span < upto OR number = last) GROUP BY 1, 2),
ct AS (SELECT number, blocks, shard, whole + coalesce(extra, 0) AS n FROM sh JOIN k USING (length) LEFT JOIN hit USING (shard, number)),
cs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY number ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM ct WHERE n > 0),
sl AS (SELECT number, blocks, unnest(range(first, least(first + n, {m.CAP} * blocks))) AS slot FROM cs),
s0 AS (SELECT number, blocks, slot // blocks AS turn, slot % blocks AS x FROM sl){rounds},
times AS (SELECT number, x AS block, count(*) AS times FROM s{m.ROUNDS} GROUP BY 1, 2),
pl AS (SELECT doc_id, size, number, coalesce(sum(size) OVER (PARTITION BY number ORDER BY ((coalesce(doc_id, 0) % 1048573 + 1048573) * 7919) % {m.BUCKETS}, doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0),
pt AS (SELECT number, start, size, unnest(range(start // {m.BLOCK}, (start + size - 1) // {m.BLOCK} + 1)) AS block FROM pl),
tk AS (SELECT number, start, sum((least(start + size, (block + 1) * {m.BLOCK}) - greatest(start, block * {m.BLOCK})) * times) AS taken FROM pt JOIN times USING (number, block) GROUP BY 1, 2),
al AS (SELECT doc_id, size, number, start FROM pl UNION ALL SELECT doc_id, size, t.number, NULL FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size = 0)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM al JOIN t USING (number) LEFT JOIN tk USING (number, start)"""


SQL: dict[str, str] = {
    "op2_mixing": _mixing_sql(),
    "op4_quantised": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e])),
p AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT r, count(*) AS n_links FROM p GROUP BY 1),
c(a, b) AS (SELECT DISTINCT vec_id, vec_id FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n USING (r) JOIN m ON m.a = v.vec_id""",
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT r, id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT id) >= 3),
s AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM k LEFT JOIN c USING (key) WHERE keeper IS NULL OR id = keeper GROUP BY 1)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)""",
    "op9_cover_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM i),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM m),
a AS (SELECT r, list(i) AS gone FROM g GROUP BY 1),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON g.r = x.r AND g.i = x.i GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r) LEFT JOIN s USING (r)""",
}
