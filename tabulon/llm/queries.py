"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import fingerprint, mixing, neardup, packing, preference, quality, secrets, sharding, substrings, urlfilter
from tabulon.llm.common import table

#: Target weights of the sources in the test tables; any other source shares the last.
SOURCE_WEIGHTS = {f"src{i}": float(i % 4 + 1) for i in range(20)} | {mixing.OTHER: 1.0}
#: Sites whose pages make up the list of op9.
LISTED_SITES = r"(^|\.)(ads-track|casino-win|spam-farm|adult-x|cheap-pills|free-bets)\."


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the model trained on the labelled ones."""
    judged = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "p_quality")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies (five-word shingles, weighted Jaccard 0.8)."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that start in an earlier one."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document, its edited text and the likeness to that and to the next one."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical weighted hash tree over shards 0 to 39 (law ``key``)."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last reply swapped: prompt and two masked completions."""
    return preference.format_preferences(preference.swapped_reply_pairs(table(spark, sf_dir, "conversations")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents repeated by Poisson draws to the target weights, globally shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[secrets.count(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page's url; the list holds the canonical URLs of the listed sites' pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    parts = urlfilter.with_parts(pages)
    listed = parts.where(F.col("host").rlike(LISTED_SITES)).select(urlfilter.canonical(F.col("host"), F.col("path")).alias("canonical"))
    return urlfilter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed_hit")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document's tokens, a sequence each."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_neardup, op3_substrings, op4_fingerprint, op5_sharding, op6_preference, op7_mixing, op8_secrets, op9_urlfilter, op10_packing)}


_OP6_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last_a, arg_max(text, CASE WHEN role = 'assistant' THEN i END) FILTER (WHERE role = 'assistant') AS reply FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, coalesce(c.last_a, c.n + 1) AS at, coalesce(o.reply, '') AS other FROM c LEFT JOIN c o ON o.conv_id // 2 = c.conv_id // 2 AND o.conv_id <> c.conv_id),
r AS (SELECT t.conv_id, i, role, CASE WHEN i = p.at THEN p.other ELSE text END AS text FROM t JOIN p USING (conv_id)
      UNION ALL SELECT p.conv_id, p.at, 'assistant', p.other FROM p JOIN c USING (conv_id) WHERE c.last_a IS NULL),
d AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, min(coalesce(t.i, r.i)) FILTER (WHERE t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text) - 1 AS k, max(t.i) AS m
      FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.i = r.i GROUP BY 1),
k AS (SELECT conv_id, coalesce(k, m) AS k FROM d),
s AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM r),
e AS (SELECT side, conv_id, i, role, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line, length(text) AS len FROM s JOIN k USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY side, conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS a FROM e WHERE i > k),
g AS (SELECT conv_id, side, string_agg(line, '' ORDER BY i) AS body, string_agg(CASE WHEN role = 'assistant' THEN a::BIGINT || ':' || (a + len + 7)::BIGINT END, ',' ORDER BY i) AS mask FROM o GROUP BY 1, 2),
q AS (SELECT conv_id, string_agg(line, '' ORDER BY i) AS prompt FROM e WHERE side = 'c' AND i <= k GROUP BY 1)
SELECT k.conv_id AS pair_id, k.k::INTEGER AS prompt_turns, coalesce(q.prompt, '') AS prompt, coalesce(x.body, '') AS chosen, coalesce(x.mask, '') AS chosen_mask, coalesce(y.body, '') AS rejected, coalesce(y.mask, '') AS rejected_mask
FROM k LEFT JOIN q USING (conv_id) LEFT JOIN g x ON x.conv_id = k.conv_id AND x.side = 'c' LEFT JOIN g y ON y.conv_id = k.conv_id AND y.side = 'r'
"""

_WEIGHTS_SQL = "VALUES " + ", ".join(f"('{k}', {v})" for k, v in SOURCE_WEIGHTS.items())
_OP7_SQL = f"""
WITH w(stratum, weight) AS ({_WEIGHTS_SQL}),
d AS (SELECT documents.*, CASE WHEN source IN (SELECT stratum FROM w WHERE stratum <> '*') THEN source ELSE '*' END AS stratum FROM documents),
n AS (SELECT stratum, count(*) AS n, any_value(weight) AS weight FROM d JOIN w USING (stratum) GROUP BY stratum),
r AS (SELECT stratum, (SELECT sum(n) FROM n) * weight / (SELECT sum(weight) FROM n) / n AS rate FROM n),
m AS (SELECT stratum, rate, greatest(ceil(rate / 32.0), 1)::INTEGER AS parts FROM r),
f AS (SELECT stratum, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY stratum ORDER BY k) AS c
      FROM m, LATERAL (SELECT unnest(generate_series(0, 99)) AS k)),
u AS (SELECT d.*, part, ('0x' || substr(md5('7|' || doc_id || '|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d JOIN m USING (stratum), LATERAL (SELECT unnest(generate_series(1, m.parts)) AS part)),
x AS (SELECT doc_id, part, count(*) AS n FROM u JOIN f ON f.stratum = u.stratum AND f.c <= u.u GROUP BY 1, 2)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, part::INTEGER AS part, copy::INTEGER AS copy,
       ('0x' || substr(md5('order|7|' || u.doc_id || '|' || part || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM u JOIN x USING (doc_id, part), LATERAL (SELECT unnest(generate_series(1, x.n)) AS copy)
"""

_OP9_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, split_part(split_part(coalesce(rest, ''), '?', 1), '#', 1) AS bare FROM a),
c AS (SELECT page_id, translate(split_part(bare, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM b),
r(v, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)}),
x AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2, 3),
k AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '') AS canonical FROM x),
l AS (SELECT DISTINCT canonical FROM k WHERE regexp_matches(host, '{LISTED_SITES}'))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, (v IS NULL AND l.canonical IS NOT NULL) AS listed_hit
FROM k LEFT JOIN l USING (canonical)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_preference": _OP6_SQL, "op7_mixing": _OP7_SQL, "op9_urlfilter": _OP9_SQL}
