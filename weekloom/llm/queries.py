"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import ann, bpe, fim, html_extract, line_dedup, lm, mixing, pii, quality_classifier, quality_rules, secrets, simhash, trie
from weekloom.llm.common import table

_W = "'[^\\x20\\x09-\\x0D]+'"


def vocabulary() -> str:
    """Path of the tokenizer file; WEEKLOOM_VOCABULARY overrides the installed public one."""
    found = os.environ.get("WEEKLOOM_VOCABULARY")
    if not found:
        import public_tokenizers

        found = public_tokenizers.path("byte_bpe_50k.json")
    return str(found)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by best-bin-first search."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines that an earlier line equals or nearly equals."""
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), "text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by the tokenization automaton."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every document."""
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    seen = quality_classifier.vectors(table(spark, sf_dir, "documents"))
    found = quality_classifier.scores(seen, quality_classifier.fit(seen, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by capped water-filling."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a fill-in-middle example, and the text that its output gives back."""
    found = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("form"), F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text by the mixed model, and by the smoothed token counts."""
    return lm.scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP11_SQL = """
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS d, length(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, conv_id::VARCHAR AS c, list({'d': d, 's': s} ORDER BY turn NULLS FIRST, d) AS p FROM t GROUP BY conv_id),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 9 * len(c))), lambda x, i:
    CASE WHEN i % 9 = 0 THEN xor(x, ord(c[(i // 9 + 1)::INT])::BIGINT) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 6 AS h FROM own),
r AS (SELECT a.conv_id, list_concat(coalesce(b.p, [])[1:a.h], a.p[a.h + 1:]) AS p FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
e AS (SELECT conv_id, len(p) AS n, p, unnest(range(0, len(p) + 1)) AS d FROM r),
k AS (SELECT conv_id, n, d, array_to_string(list_transform(p[1:d], lambda x: x.d), '') AS k, CASE WHEN d = 0 THEN 0 ELSE p[d].s END AS s FROM e),
g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(s) AS s, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM k GROUP BY k, d),
u AS (SELECT a.k, count(*) FILTER (b.d = a.d + 1) AS kids FROM g a JOIN g b ON starts_with(b.k, a.k) GROUP BY a.k),
f AS (SELECT a.k, count(*) FILTER (u.kids = 0) AS leaves, sum((b.n - 1) * b.s) AS saved FROM g a JOIN g b ON starts_with(b.k, a.k) JOIN u ON u.k = b.k GROUP BY a.k)
SELECT g.conv_id, g.d AS depth, up.conv_id AS parent_conv_id, g.n AS n_convs, u.kids AS n_children, f.leaves AS n_leaves, f.saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN u USING (k) JOIN f USING (k) LEFT JOIN g up ON up.d = g.d - 1 AND starts_with(g.k, up.k)
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM g
"""

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_W})), 0)::BIGINT AS size, md5('42|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    >= cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    w * (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (WHERE NOT capped) OVER ())::DOUBLE END AS target FROM c),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(3, whole + CASE WHEN source_size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

QUERIES = {f.__name__: f for f in (op1_ann, op2_secrets, op3_line_dedup, op4_pii, op5_bpe, op6_quality_rules, op7_simhash, op8_quality_classifier, op9_mixing, op10_html, op11_trie, op12_fim, op13_lm)}
ORACLES = {"op9_mixing": OP9_SQL, "op11_trie": OP11_SQL, "op12_fim": OP12_SQL}
