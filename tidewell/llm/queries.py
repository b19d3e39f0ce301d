"""The registered queries of the training-data operators, one an operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, langid, lm, mixing, pii, quality, simhash, suffix, toxicity
from .common import documents, fold, labels, staged

WORD_SQL = r"'[^\x20\x09-\x0D]+'"
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels(spark, sf_dir), learn=~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(documents(spark, sf_dir)).drop("n_chunks")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, added = F.col("base"), F.col("added")
    found = pii.redact_spans(documents(spark, sf_dir))
    return found.select("doc_id", *pii.counts(base), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.array_sort(F.concat(base, added))).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm.score(documents(spark, sf_dir), learn=fold(F.col("doc_id"), 7) != 2)
    return got.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = staged(quality.measure(documents(spark, sf_dir)), "measured")
    return quality.judge(measured, quality.fit(measured, labels(spark, sf_dir))).drop("anomaly")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, learn=~held)
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


# what SQL can express of operators whose whole result it can't


def llm_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_spans(documents(spark, sf_dir)).select("doc_id", *pii.counts(F.col("base")))


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def llm_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm.score(documents(spark, sf_dir), learn=F.lit(True))
    return got.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def llm_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), None).drop("anomaly", "kept")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_toxicity, op4_simhash, op5_exact_dedup, op6_pii, op7_mixing, op8_lm_scoring, op9_quality, op10_language_id, llm_pii_counts, llm_mix_targets, llm_token_counts, llm_rule_counts)}

ORACLE_SQL = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER_SQL} AS k FROM documents), g AS (SELECT k, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY k)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM t JOIN g USING (k)""",
    "llm_pii_counts": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, len(regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
            len(list_filter(regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 999) <= 255)))) AS n_ip,
            len(list_filter(list_transform(regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda m: length(m) BETWEEN 13 AND 19
                AND list_sum(list_transform(string_split(reverse(m), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0)) AS n_card,
            len(list_filter(regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM t""",
    "llm_mix_targets": rf"""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD_SQL})) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t GROUP BY source),
        r AS (SELECT *, 2.0 * source_size / w AS ratio, sum(source_size) OVER () * 1.5 AS whole FROM s),
        c AS (SELECT *, (whole - coalesce(sum(2.0 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        g AS (SELECT source, source_size, round(least(2.0 * source_size, (SELECT max(level) FROM c) * w), 6)::DOUBLE AS target FROM c)
        SELECT doc_id, size, source_size, target FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source""",
    "llm_token_counts": rf"""WITH t AS (SELECT doc_id, unnest(list_append(regexp_extract_all({_LOWER_SQL}, {WORD_SQL}), chr(10))) AS w FROM documents), c AS (SELECT w, count(*) AS c FROM t GROUP BY w), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, max(n)::BIGINT AS train_tokens, round(sum(log10((c + 1) / (n + v + 1)::DOUBLE)), 5) AS base_score FROM t JOIN c USING (w), s GROUP BY doc_id""",
    "llm_rule_counts": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS ws FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM t WHERE len(ws) > 4), f AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS five FROM g),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM f) WHERE n > 1), k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(5) z(o) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, {WORD_SQL}) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
            len(ws) < 10 OR 100 * coalesce(k.n, 0) > 20 * len(ws) AS base_failed FROM t LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
