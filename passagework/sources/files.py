"""Files as tables: text, CSV, inventory, validation, ingest report, evaluation records.

The file operators take the columns of Spark's ``binaryFile`` source: path,
modificationTime, length, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagework.functions import constants as K


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or '' without one."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def decoded_text(content: Column) -> Column:
    """UTF-8 text, or Latin-1 when the bytes are no UTF-8; line ends become newlines."""
    as_string = content.cast("string")
    text = F.when(F.is_valid_utf8(as_string), as_string).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def scan_text(files: DataFrame) -> DataFrame:
    """One document per file."""
    return files.select("path", decoded_text(F.col("content")).alias("text"))


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Types are inferred in a second pass unless a schema is given."""
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def file_inventory(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        filename(F.col("path")).alias("filename"),
        extension(F.col("path")).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        F.col("modificationTime").alias("modified_date"),
        F.md5("content").alias("file_hash"),
    )


def supported(files: DataFrame) -> DataFrame:
    """Adds success and error: files of other types become error rows."""
    ok = extension(F.col("path")).isin(K.SUPPORTED_EXTENSIONS)
    message = F.concat(F.lit("Unsupported file format: "), extension(F.col("path")))
    return files.withColumns({"success": ok, "error": F.when(~ok, message)})


def visual_supported(files: DataFrame) -> DataFrame:
    """Adds success and error: only PDF files can be searched as page images."""
    ok = F.lower("path").endswith(".pdf")
    return files.withColumns({"success": ok, "error": F.when(~ok, "Visual mode only supports PDF files")})


def upload_rejection(path: Column, size: Column, limit: int = K.UPLOAD_LIMIT_BYTES) -> Column:
    """Reason to reject an upload, or null."""
    return (
        F.when(
            size > limit,
            F.concat(F.lit("too large ("), F.format_string("%.1f", size / (1024.0 * 1024.0)), F.lit(f"MB), at most {limit / 1048576:g}MB")),
        )
        .when(size == 0, "empty")
        .when(
            ~extension(path).isin(K.SUPPORTED_EXTENSIONS),
            F.concat(F.lit("unsupported extension: "), extension(path)),
        )
    )


def ingest_report(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files and chunks per outcome and reason, from rows path, success, chunks, error."""
    return results.groupBy(*by, "success", "error").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks")
    )


def combine_ingest(text: DataFrame, visual: DataFrame) -> DataFrame:
    """Outcome per file over both systems; one success is enough.

    ``text``: path, success, chunks, error; ``visual``: path, success, pages, error.
    """
    t = text.select("path", F.col("success").alias("text_success"), F.col("chunks").alias("text_chunks"), F.col("error").alias("_te"))
    v = visual.select("path", F.col("success").alias("visual_success"), F.col("pages").alias("visual_pages"), F.col("error").alias("_ve"))
    both = t.join(v, "path", "full_outer").na.fill(False, ["text_success", "visual_success"]).na.fill(0, ["text_chunks", "visual_pages"])
    ok = F.col("text_success") | F.col("visual_success")
    errors = F.concat_ws(
        "; ", F.concat(F.lit("Text: "), "_te"), F.concat(F.lit("Visual: "), "_ve")
    )
    return both.select(
        "path", "text_success", "visual_success", "text_chunks", "visual_pages", ok.alias("success"),
        F.when(~ok, F.coalesce(F.nullif(errors, F.lit("")), F.lit("No processing systems available"))).alias("error"),
    )


EVALUATION_SCHEMA = """query string, best_retriever string, performance_ranking array<string>, timestamp string,
evaluations array<struct<query: string, retriever_type: string, answer: string,
  retrieval_results: array<struct<content: string, score: double>>,
  metrics: struct<query_time: double, total_results: bigint, avg_score: double, max_score: double, tokens_used: bigint, cost_estimate: double>,
  timestamp: string, relevance_score: double, completeness_score: double, accuracy_score: double, overall_score: double,
  evaluation_method: string, human_feedback: string>>"""


def scan_evaluations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Evaluation records, one row per query and retriever. The schema is fixed: no pass to infer it."""
    raw = spark.read.schema(EVALUATION_SCHEMA).json(path, multiLine=multi_line)
    return raw.select("best_retriever", F.explode("evaluations").alias("e")).select("best_retriever", "e.*")


def evaluation_results(evaluations: DataFrame) -> DataFrame:
    """One row per retrieved passage of an evaluation record."""
    return evaluations.select(
        "query", "retriever_type", "completeness_score", F.posexplode("retrieval_results").alias("i", "r")
    ).select("query", "retriever_type", "completeness_score", (F.col("i") + 1).alias("rank"), "r.content", "r.score")
