"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm.common import documents, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.quality import fit_quality, score_quality

    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op4_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.sstable import read_shards, write_shards

    return read_shards(spark, write_shards(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir), digest=True)


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.sharding import minimax_shards

    return minimax_shards(documents(spark, sf_dir), 16)


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mergelake.llm.pieces import encode_and_decode

    return encode_and_decode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL


ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
        common AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
                   GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.doc_id, k.place, k.line, coalesce(c.holder <> k.doc_id, false) AS gone
                   FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
