"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapane.llm.common import documents


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is, unless a caller gives another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_bytes of every document, by greedy longest pieces of a 50,000-piece byte vocabulary."""
    from terrapane.llm.token_counts import token_counts, vocabulary

    return token_counts(documents(spark, sf_dir), vocabulary(vocabulary_path("byte_bpe_50k.tiktoken")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; `und` and 0 for a text that is null or has no letter."""
    from terrapane.llm.language_id import identify
    from terrapane.llm.token_counts import vocabulary

    return identify(documents(spark, sf_dir), vocabulary(vocabulary_path("byte_bpe_multi_50k.tiktoken")))


def tokens_written(docs: DataFrame) -> DataFrame:
    """Write the token files of `docs` to the shared folder and read them back."""
    from terrapane.llm.common import temporary_path
    from terrapane.llm.token_files import read_tokens, write_tokens

    spark = docs.sparkSession
    path = temporary_path(spark, "tokens")
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        write_tokens(docs, path, f.read())
    return read_tokens(spark, path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files; a null text has its end token only."""
    return tokens_written(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base columns, base_failed and kept of every document; null and empty texts fail."""
    from terrapane.llm.quality_rules import quality_rules

    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; a null source is one of its own, last in order."""
    from terrapane.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document; a null text is an end alone."""
    from terrapane.llm.lm_scoring import score

    return score(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page; a null URL has an empty host and path, and no rule."""
    from terrapane.llm.url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null text scores as an empty one."""
    from terrapane.llm.quality_classifier import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items and matched of every document; null texts are clean."""
    from terrapane.llm.decontaminate import decontaminated

    out = decontaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "items", "matched")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every document; one row of a class is kept, and a null text is a class of its own."""
    from terrapane.llm.near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_language_id,
        op3_token_files,
        op4_quality_rules,
        op5_mixing,
        op6_lm_scoring,
        op7_url_filter,
        op8_decontamination,
        op9_quality_classifier,
        op10_near_duplicates,
    )
}

_W = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w
), u AS (
  SELECT doc_id, row_number() OVER () AS r, t, ws, ls, tri FROM g
), e AS (
  SELECT r, unnest(tri) AS gram, unnest(range(1, len(tri) + 1)) AS i FROM u
), d AS (
  SELECT r, gram, i, count(*) OVER (PARTITION BY r, gram) AS n FROM e
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), b AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM u LEFT JOIN p USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         10 * n_symbols > 3 * n_words
         OR 10 * length(regexp_replace(t, '[^!]', '', 'g')) > 3 * n_words
         OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * len(string_split(t, chr(10))))
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > word_chars
         OR 5 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 2 * word_chars) AS kept
FROM f
""",
    "op5_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 9)) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM s
), k AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS stop, sum(source_size) OVER ()::DOUBLE AS everything FROM w
), l AS (
  SELECT *, (everything - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY stop, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY stop, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k
), m AS (
  SELECT *, max(CASE WHEN level <= stop THEN level END) OVER () AS best FROM l
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(best * w, 'infinity'::DOUBLE)) AS target FROM m
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, target - whole * source_size AS rest FROM r
), hs AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), c AS (
  SELECT q.source, coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS inside, min(CASE WHEN upto > rest THEN h END) AS edge
  FROM q LEFT JOIN hs ON q.source IS NOT DISTINCT FROM hs.source GROUP BY q.source
), b AS (
  SELECT q.*, CASE WHEN edge IS NULL THEN 1 << 40 ELSE edge + CASE WHEN words - (rest - inside) <= rest - inside THEN 1 ELSE 0 END END AS below
  FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source LEFT JOIN hs ON q.source IS NOT DISTINCT FROM hs.source AND hs.h = c.edge
)
SELECT doc_id, size, source_size, target, CAST(size * least(3, whole + CASE WHEN h < below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
""",
}
