"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, line_dedup, lm_score, packing, passage_dedup, quality, rules, simhash, toxicity
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.dedup_report(read_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_against_good(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(turns.unionByName(own))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_line_dedup, op4_lm_score, op5_simhash, op6_toxicity, op7_rules, op8_packing, op9_chat, op10_language)}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 1))) AS pos FROM l WHERE text IS NOT NULL),
v AS (SELECT doc_id, pos, ls[pos + 1 : pos + 3] AS win FROM w),
x AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM v
      WHERE regexp_matches(array_to_string(win, ' '), '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM x WHERE rn > 1),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l WHERE text IS NOT NULL),
k AS (SELECT e.doc_id, count(c.pos) AS n_removed, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE c.pos IS NULL) AS kept
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id),
d AS (SELECT l.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
             CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text
      FROM l LEFT JOIN k ON l.doc_id = k.doc_id),
g AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split_regex(text, '[^\x20\x09-\x0D]+') AS gaps FROM d),
z AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS lo FROM g WHERE len(ws) >= 50),
p AS (SELECT doc_id, n, lo, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS win FROM z),
q AS (SELECT doc_id, lo, row_number() OVER (PARTITION BY win ORDER BY doc_id, lo) AS rn FROM p WHERE lo <= n - 50),
m AS (SELECT DISTINCT doc_id, unnest(range(lo, lo + 50)) AS i FROM q WHERE rn > 1),
t AS (SELECT doc_id, len(ws) AS n, gaps[len(ws) + 1] AS tail, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, unnest(gaps[1 : len(ws)]) AS gap
      FROM g WHERE doc_id IN (SELECT doc_id FROM m)),
s AS (SELECT t.*, m.i IS NOT NULL AS gone, lag(m.i IS NOT NULL, 1, false) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS was
      FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.i = m.i),
u AS (SELECT *, sum(CASE WHEN gone AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, max(i) + 1 AS stop, arg_min(gap, i) AS before FROM u WHERE gone GROUP BY doc_id, run),
b AS (SELECT r.doc_id, r.run, u.gap IS NOT NULL AS more, contains(u.gap, chr(10)) AND NOT contains(r.before, chr(10)) AS ends
      FROM r LEFT JOIN u ON u.doc_id = r.doc_id AND u.i = r.stop),
y AS (SELECT u.doc_id, u.i, CASE WHEN NOT gone AND (NOT was OR b.ends) THEN gap || word WHEN NOT gone THEN word
                                 WHEN NOT was AND b.more AND NOT b.ends THEN gap ELSE '' END || CASE WHEN u.i = n - 1 AND NOT gone THEN tail ELSE '' END AS part
      FROM u LEFT JOIN b ON u.doc_id = b.doc_id AND u.run = b.run),
f AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS text FROM y GROUP BY doc_id)
SELECT d.doc_id, d.n_lines, d.n_removed, CAST(coalesce(length(d.text), 0) - coalesce(length(coalesce(f.text, d.text)), 0) AS BIGINT) AS n_cut, coalesce(f.text, d.text) AS text
FROM d LEFT JOIN f ON d.doc_id = f.doc_id""",
    "op9_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
s AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS safe, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS safe_role FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + CASE WHEN before = role THEN 5 ELSE length(safe_role) + 15 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
}
