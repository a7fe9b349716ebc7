"""Named queries of the text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import mojibake, packing, parsing, provenance, secrets, tokens
from lodegraph.session import table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_files(table(spark, d, "file_contents"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("not valid").select("file_id")


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.error_rates(_parsed(spark, d))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cursor_api_config").select("config_id", F.col("cursor_api.headers.authorization").alias("authorization"))


def _secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "file_contents"), table(spark, d, "files"), _headers(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _secrets(spark, d).select("record_table", "record_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    hits = _secrets(spark, d)
    files = secrets.redacted(table(spark, d, "file_contents"), "file_id", "content", hits, "file_contents")
    return files.unionByName(secrets.redacted(_headers(spark, d), "config_id", "authorization", hits, "cursor_api_config"))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "file_contents"), table(spark, d, "files"), table(spark, d, "library_files")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.found(*_sources(spark, d))


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(*_sources(spark, d)).select("file_id", "generated", "third_party", "minified", "data")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    windows = [(r.window_id, r.capacity_tokens) for r in table(spark, d, "context_windows").select("window_id", "capacity_tokens").collect()]
    return packing.pack(tokens.token_counts(docs, "doc_id", "text"), "doc_id", windows, docs.count())


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packing(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = mojibake.learn(docs, "text", "source")
    return mojibake.repair(docs, "doc_id", "text", "source", model).where("n_restored + n_lost > 0")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_errors, p2_rates, p3_found, p3_redacted, p5_found, p5_kinds, p6_ids, p7_packing, p7_fill, p8_found, p8_repaired)}


def oracle_sql() -> dict[str, str]:
    return {}
