"""The registered queries of this package, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chat, read_back
from .cotrain import classify_quality
from .language import identify_language
from .minhash import near_duplicates
from .mixing import plan_mix
from .packing import assemble, pack_documents
from .quality_rules import quality_report
from .suffix_arrays import dedup_suffix_array
from .suffix_trees import dedup_substrings
from .topk import exact_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences themselves, digested: their words in order."""
    out = assemble(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("group", "bin", "bin_length", "bin_used", F.size("pieces").alias("n_pieces"), F.sha2("text", 256).alias("text_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffix_array(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = plan_mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.rows.select("doc_id", "size", "source_size", "target", "taken", "shards")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that no draw decides."""
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    out = identify_language(docs, train=rest != 2, key=F.col("doc_id"))
    return out.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=F.col("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chat(turns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    out = classify_quality(docs, _table(spark, sf_dir, "labels"))
    kept = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return out.select("doc_id", "quality_score", "toxic_score", kept.alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_suffix_array_dedup,
        op3_mix_sources,
        op4_language_id,
        op5_quality_rules,
        op6_chat_formatting,
        op7_substring_dedup,
        op8_minhash_near_dedup,
        op9_exact_top_k,
        op10_quality_classifier,
        mix_targets,
        packed_sequences,
    )
}

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def _repeats_sql(window: int) -> str:
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 1} + 1)) AS i FROM d WHERE len(ws) >= {window}),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS win FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM r, (SELECT unnest(range(0, {window})) AS j) WHERE n > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op2_suffix_array_dedup": _repeats_sql(50),
    "op7_substring_dedup": _repeats_sql(20),
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_trailing,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets FROM l),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 7]) AS n FROM w),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (SELECT unnest(range(0, 8)) AS j) WHERE k.n > 1 GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, n_trailing, n_bullets,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS n_letterless
  FROM d JOIN l USING (doc_id) JOIN e USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 100000 AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
  AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines
  AND 10 * n_trailing <= 3 * n_lines AND 10 * n_bullets <= 9 * n_lines AND 10 * n_letterless <= 3 * n_words AS kept
FROM f""",
    "op6_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, role || text AS said FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- Control strings take 8, 8 and 7 characters; each backslash and each opening of a control string in a role or text one more.
  sum(23 + length(said) + length(said) - length(replace(said, '\', ''))
    + (length(role) - length(replace(role, '<|', '')) + length(text) - length(replace(text, '<|', ''))) // 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "mix_targets": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 1.5 * sum(words) OVER () AS due FROM s),
-- Sources fill up in the order of their limit for each unit of weight; those before take their limit, the rest shares what is left.
r AS (SELECT *, due - coalesce(sum(2 * words) OVER before, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open FROM w
  WINDOW before AS (ORDER BY 2 * words / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_over * weight / open > 2 * words AS is_full FROM r),
l AS (SELECT any_value(due) - coalesce(sum(2 * words) FILTER (is_full), 0) AS left_over, sum(weight) FILTER (NOT is_full) AS open FROM f),
t AS (SELECT source, words, CASE WHEN is_full THEN 2 * words ELSE l.left_over * weight / l.open END AS target FROM f, l)
SELECT doc_id, size, t.words::BIGINT AS source_size, target::DOUBLE AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "op8_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, sum(hash(g)::HUGEINT) AS x, sum(hash(g || '#')::HUGEINT) AS y FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, x, y) AS rep FROM c),
rs AS (SELECT s.doc_id, g FROM s JOIN cls USING (doc_id) WHERE cls.rep = s.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach AS (SELECT rep AS node, rep AS top FROM cls UNION SELECT e.v, reach.top FROM reach JOIN e ON e.u = reach.node),
comp AS (SELECT node, min(top) AS comp FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.comp, d.doc_id) AS component_id, coalesce(comp.comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.node = cls.rep""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
