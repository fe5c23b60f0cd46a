"""Full-text index as immutable segments of postings and conjunctive search over it."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.fields import search_tokens
from ..session import cut_lineage, shared_folder


def build_postings(reports: DataFrame, bodies: DataFrame, summaries: DataFrame) -> DataFrame:
    """(report_id, token, field, tf): title = A, whole current body = B, summary of the head = C."""
    part = lambda rows, key, text, field: rows.select(
        F.col(key).alias("report_id"), F.lit(field).alias("field"), F.col(text).alias("text")
    )
    texts = (
        part(reports, "id", "title", "A")
        .unionByName(part(bodies, "report_id", "body", "B"))
        .unionByName(part(summaries, "report_id", "summary", "C"))
    )
    # the texts meet by report, long before they are many tokens; the counts of a text are those of
    # its report and field, unless these come again in another row
    texts = texts.withColumn("_rows", F.count("*").over(W.partitionBy("report_id", "field")))
    again = _token_counts(texts.where("_rows > 1")).groupBy("report_id", "token", "field").agg(F.sum("tf").alias("tf"))
    return _token_counts(texts.where("_rows = 1")).unionByName(again)


#: Tokens counted at a time.
_SLICE = 1 << 18


def _token_counts(texts: DataFrame) -> DataFrame:
    """(report_id, token, field, tf) of every row (report_id, field, text)."""

    def run(batches):
        for batch in batches:
            ids, fields, tokens = (batch.column(i) for i in range(3))
            ends = tokens.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            # rows that begin in one slice of tokens are counted together
            firsts = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // _SLICE, prepend=-1))
            for a, b in zip(firsts, [*firsts[1:], len(sizes)]):
                words = tokens.slice(a, b - a).flatten().dictionary_encode()
                if not len(words):
                    continue
                row = np.repeat(np.arange(a, b), sizes[a:b])
                found, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(found, len(words.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), words.dictionary.take(pa.array(word)), fields.take(pa.array(row)), pa.array(tf, pa.int64())],
                    ["report_id", "token", "field", "tf"],
                )

    schema = StructType(
        [texts.schema["report_id"], StructField("token", StringType()), StructField("field", StringType()), StructField("tf", LongType())]
    )
    return texts.select("report_id", "field", search_tokens(F.col("text")).alias("tokens")).mapInArrow(run, schema)


def write_postings(postings: DataFrame, folder: str) -> None:
    """Cluster by token, so a search reads few row groups; frequent tokens span several files.

    The postings are stored first: finding the ranges reads them once more than dealing them out.
    """
    cut_lineage(postings, "postings").repartitionByRange("token", "report_id").sortWithinPartitions(
        "token", "report_id"
    ).write.parquet(folder)


def rebuild(spark: SparkSession, postings: DataFrame) -> tuple[str, DataFrame]:
    """Full rebuild into a new folder; running it again gives the same index."""
    folder = shared_folder(spark, "postings")
    write_postings(postings, folder)
    return folder, spark.read.parquet(folder)


def add_segment(index: str, segment: int, postings: DataFrame, touched: DataFrame | None = None) -> None:
    """Write the postings of new or changed reports as the next segment of the index folder.

    ``touched``: (report_id) of changed or deleted reports; what earlier segments say of them no
    longer holds. Segments are never rewritten; a number is used once, in ascending order.
    """
    write_postings(postings, f"{index}/postings/segment={segment}")
    ids = postings.select("report_id").limit(0) if touched is None else touched.select("report_id").distinct()
    ids.write.parquet(f"{index}/replaced/segment={segment}")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """Postings that hold: those of a report since the last segment that replaced it.

    A filter on the token passes the join and reaches the scan of every segment.
    """
    since = spark.read.parquet(f"{index}/replaced").groupBy("report_id").agg(F.max("segment").alias("_since"))
    held = spark.read.parquet(f"{index}/postings").join(since, "report_id", "left")
    return held.where("segment >= coalesce(_since, 0)").select("report_id", "token", "field", "tf")


def merge_segments(spark: SparkSession, index: str, merged: str) -> None:
    """Write what holds of all segments as the first segment of a new index folder."""
    add_segment(merged, 0, read_index(spark, index))


def query_tokens(spark: SparkSession, text: str) -> list[tuple[str, bool]]:
    """Distinct tokens of a search box entry, cut by the same rule as the index, each with a
    flag that says it is a lone Han character."""
    tokens = F.transform(
        F.array_distinct(search_tokens(F.lit(text))),
        lambda t: F.struct(t.alias("token"), t.rlike(r"^\p{IsHan}$").alias("lone")),
    )
    row = spark.range(1).select(tokens.alias("t")).first()
    return [(item["token"], item["lone"]) for item in row["t"]]


def search(postings: DataFrame, text: str) -> DataFrame | None:
    """(report_id, hits) of reports that contain every token in any field; None for a blank query.

    ``hits``: occurrences of the tokens. A lone Han character is never a token of a longer run, but
    it is part of its bigrams. The postings are read once.
    """
    tokens = query_tokens(postings.sparkSession, text)
    if not tokens:
        return None
    token = F.col("token")
    matches = [token.contains(t) if lone else token == t for t, lone in tokens]
    if any(lone for _, lone in tokens):
        candidates = postings.where(reduce(or_, matches))
    else:
        # a list of literals reaches the parquet scan
        candidates = postings.where(token.isin([t for t, _ in tokens]))
    flags = [F.bool_or(hit).alias(f"_h{i}") for i, hit in enumerate(matches)]
    found = candidates.groupBy("report_id").agg(F.sum("tf").alias("hits"), *flags)
    return found.where(" AND ".join(f"_h{i}" for i in range(len(matches)))).select("report_id", "hits")


def matching_reports(postings: DataFrame, text: str) -> DataFrame | None:
    """report_id of the reports that ``search`` finds."""
    found = search(postings, text)
    return None if found is None else found.select("report_id")
