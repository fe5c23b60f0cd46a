"""Raw files, page texts and converted bodies: landing and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.cleaning import clean_markdown
from ..functions.text import strip


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def land_files(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows -> file attributes; a reject keeps its row and says why."""
    name = strip(F.element_at(F.split(F.col("path"), "/"), -1))
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    return (
        files.withColumn("filename", F.coalesce(F.nullif(name, F.lit("")), F.lit("upload.bin")))
        .withColumn(
            "reject_reason",
            F.when(~suffix.isin(K.UPLOAD_EXTENSIONS), "unsupported_format").when(
                F.col("length") > K.UPLOAD_MAX_BYTES, "too_large"
            ),
        )
        .withColumn("size_bytes", F.col("length"))
        # rejected content is not hashed
        .withColumn("sha256", F.when(F.col("reject_reason").isNull(), F.sha2("content", 256)))
        .drop("content", "length")
    )


def scanned_gate(pages: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """Files whose pages carry too few characters on average are scans."""
    mean = F.col("chars") / F.col("n_pages")
    return (
        pages.groupBy(file)
        .agg(
            F.count("*").alias("n_pages"),
            F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"),
        )
        .withColumn("reject_reason", F.when(mean < K.SCAN_MIN_CHARS_PER_PAGE, "scanned"))
    )


def converted_bodies(raw: DataFrame, text: str = "body") -> DataFrame:
    """Gate on the raw length, then clean; rejected bodies have no cleaned text."""
    too_short = F.length(strip(F.col(text))) < K.MARKDOWN_MIN_CHARS
    return (
        raw.withColumn("error_code", F.when(too_short, "empty_output"))
        .withColumn("cleaned", F.when(~too_short, clean_markdown(F.col(text))))
        .withColumn("chars_raw", F.length(text))
        .withColumn("chars_cleaned", F.length("cleaned"))
    )
