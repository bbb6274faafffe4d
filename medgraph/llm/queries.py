"""The registered queries of the thirteen operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import exact, lines, lm, mixing, packing, phrases, quality, sharding, simhash, spelling, suffix, tokens, toxicity


def vocabulary() -> str:
    """Path of the public word-end BPE vocabulary; a folder of the same files may be named in MEDGRAPH_TOKENIZERS."""
    folder = os.environ.get("MEDGRAPH_TOKENIZERS")
    if folder:
        return os.path.join(folder, "word_bpe_49k.json")
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(_documents(spark, sf_dir))


def op6_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_documents(spark, sf_dir), vocabulary())


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_fuzzy_lines, op4_exact_dedup, op5_suffix_dedup, op6_bpe_words, op7_pitman_yor, op8_packing, op9_sharding, op10_simhash, op11_mixing, op12_phrases, op13_spelling)}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM pieces),
        grams AS (
            SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)
            GROUP BY ALL),
        totals AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
        frequent AS (SELECT * FROM grams WHERE a >= 100),
        cuts AS (
            SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS tail
            FROM (SELECT *, unnest(range(1, m)) AS k FROM frequent WHERE m > 1)),
        scored AS (
            SELECT c.lang, c.m, c.phrase, c.a, h.a AS l, t.a AS r, n, k, ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
            FROM cuts c JOIN frequent h ON h.lang = c.lang AND h.phrase = c.head JOIN frequent t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals ON totals.lang = c.lang),
        worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i : i + w - 1], ' ') AS phrase, a
            FROM (SELECT *, unnest(range(1, m - w + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS w FROM frequent WHERE m > 2)))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM worst w
        WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.a >= 100 * w.a)
        QUALIFY rank <= 2000
    """,
}
