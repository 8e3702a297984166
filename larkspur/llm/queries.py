"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import embedding_dedup, filter_audit, licenses, line_dedup, media, mixing, packing, simhash, suffix_dedup, token_counts, toxicity, url_filter, variants


def tokenizer(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _read(s, d, "documents")
    return {
        "op1_url_filter": lambda s, d: url_filter.judge(_read(s, d, "pages")),
        "op2_source_mixing": lambda s, d: mixing.mix(docs(s, d)),
        "op3_token_counts": lambda s, d: token_counts.token_counts(docs(s, d), tokenizer("byte_bpe_50k.tiktoken")),
        "op4_packing": lambda s, d: packing.pack(docs(s, d), tokenizer("byte_bpe_50k.json")),
        "op5_embedding_dedup": lambda s, d: embedding_dedup.dedup(_read(s, d, "embeddings")),
        "op6_license_scan": lambda s, d: licenses.scan(docs(s, d)),
        "op7_suffix_dedup": lambda s, d: suffix_dedup.digest(docs(s, d)),
        "op8_toxicity": lambda s, d: toxicity.digest(docs(s, d), _read(s, d, "labels")),
        "op9_media_columns": lambda s, d: media.digest(docs(s, d)),
        "op10_simhash_dedup": lambda s, d: simhash.digest(docs(s, d)),
        "op11_filter_audit": lambda s, d: filter_audit.audit(docs(s, d), _read(s, d, "labels")),
        "op12_line_dedup": lambda s, d: line_dedup.digest(docs(s, d)),
        "op13_spelling_variants": lambda s, d: variants.group(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.SQL,
        "op5_embedding_dedup": embedding_dedup.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_line_dedup": line_dedup.SQL,
        "op13_spelling_variants": variants.SQL,
    }
