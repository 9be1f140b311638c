"""The operN queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, codes, decontaminate, fim, imatch, mixing, packing, quality, secrets, sharding, simhash, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.matched(_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_table(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(_table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_imatch": op7_imatch,
    "op8_ann": op8_ann,
    "op9_substrings": op9_substrings,
    "op10_sharding": op10_sharding,
    "op11_codes": op11_codes,
    "op12_fim": op12_fim,
    "op13_decontaminate": op13_decontaminate,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The crc32 of a text's UTF-8 bytes: table-driven, the table made by the rule.
_CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
bytes AS (SELECT doc_id, text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
hashed AS (SELECT doc_id, CAST(n + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(1, n + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM bytes, crc)"""



def _codes_sql(rounds: int = 4) -> str:
    """The rounds written out: each assigns every part (a) and takes the books (b) on from there."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, p, min(dist) AS dist, arg_min(e, (dist, e)) AS e FROM (
  SELECT row, x.p, e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS dist FROM x JOIN b{r} c ON x.p = c.p AND x.j = c.j GROUP BY ALL) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
  SELECT a.p, a.e, x.j, CAST(floor(sum(x.v) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v FROM a{r} a JOIN x ON a.row = x.row AND a.p = x.p GROUP BY ALL) m ON b.p = m.p AND b.e = m.e AND b.j = m.j)""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT row, i // w AS p, i % w AS j, CAST(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, row AS e, j, v FROM x WHERE row < 256),
{", ".join(steps)},
o AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (row), h"""


_SMALL_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op12_fim": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS d FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(d, 1 + 8 * k, 8) AS BIGINT)) AS h FROM t),
f AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op13_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({_SMALL_WORDS}, []) AS ws FROM documents),
i AS (SELECT item_id, {_SMALL_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[s:s + 9], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, item_id, g.k, s FROM g JOIN win ON g.k = win.k AND g.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_mixing": f"""WITH s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM s GROUP BY 1),
b AS (SELECT *, [5, 2, 1][(i - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 2 * source_size / [5, 2, 1][(i - 1) % 3 + 1] AS r FROM a),
c AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM b WINDOW w AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT first(level ORDER BY r, i) AS final FROM c WHERE level * weight < cap),
d AS (SELECT source, source_size, CASE WHEN level * weight < cap THEN weight * final ELSE CAST(cap AS DOUBLE) END AS target FROM c, o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM d),
u AS (SELECT doc_id, source, size, k, seed, CAST('0x' || substr(md5((seed // 4) || ':' || k), 1 + 8 * (seed % 4), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM s, range(16) q(seed)),
t AS (SELECT u.source, seed, sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) AS extra FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source GROUP BY 1, 2),
f AS (SELECT e.source, source_size, target, rate, first(seed ORDER BY abs(floor(rate) * source_size + extra - target), seed) AS seed FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source AND u.seed = f.seed""",
    "op9_substrings": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)""",
    "op10_sharding": f"""WITH {_CRC},
u AS (SELECT doc_id, j, -ln(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || (j // 2)), 1 + 16 * (j % 2), 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) + 0.5 / CAST(4503599627370496 AS DOUBLE)) AS score FROM documents, range(41) q(j)),
p AS (SELECT doc_id, first(j ORDER BY score, j) FILTER (j < 40) AS shard, first(j ORDER BY score, j) AS grown_shard FROM u GROUP BY 1)
SELECT h.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(coalesce(CAST(h.doc_id AS VARCHAR), 'null')), 1, 4) AS BIGINT) % 256, h.doc_id, text_crc32, size) - 1 AS slot
FROM hashed h JOIN p USING (doc_id)""",
}
