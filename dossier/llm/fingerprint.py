"""Mergeable bottom-k fingerprints of documents, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest shingle hashes kept. The error of an estimated resemblance r is sqrt(r (1 - r) / K).
K = 128
WORDS = 5


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """Distinct hashes, ascending, of all ``width``-word shingles of the lower-cased text.

    A text of fewer words is one shingle; NULL and texts without words have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        full = F.transform(
            F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))
        )
        return F.when(n >= width, full).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    # a let-binding: the word hashes are made once and read by the shingles
    bound = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of)
    return F.array_sort(F.array_distinct(bound[0]))


def sketch(text: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(shingle_hashes(text), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """Sketch of all parts of every key: counted per hash first, so no key needs its parts in one place."""
    hashes = df.select(key, F.explode(column).alias("h")).distinct()
    ranked = hashes.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("n") <= k)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    place = (F.element_at(a, -1).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (0 for an empty a)."""
    r = resemblance(a, b, k)
    n, m = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n + m) / n))


def as_text(a: Column) -> Column:
    """Sketch as one string: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every row with the text of the next row by doc_id (after the last: the first), as next_text.

    Blocks of doc_id at its quantiles are ordered each on its own; the first row of every block
    serves the last of the one before. What is put in one place has one row per block.
    """
    spark = docs.sparkSession
    blocks = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / blocks) for i in range(1, blocks))) if blocks > 1 else F.array(F.lit(0.5)), 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))).cast("array<bigint>")
    dealt = docs.withColumn("block", F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    inner = dealt.withColumn("own_next", F.lead(F.struct(F.col("text").alias("t"))).over(order))
    firsts = dealt.groupBy("block").agg(F.min(F.struct("doc_id", F.col("text").alias("t"))).alias("first"))
    ring = Window.orderBy("block")
    overall = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select(
        "block", F.coalesce(F.lead("first.t").over(ring), F.first("first.t").over(overall)).alias("head"),
    )
    # NULL texts are empty ones by now, so a NULL means that there is no next row in the block
    joined = inner.join(heads, "block")
    return joined.withColumn("next_text", F.coalesce(F.col("own_next.t"), "head")).drop("block", "own_next", "head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    In: doc_id, text (NULL: empty); other columns are ignored. Out: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_distinct (estimated distinct
    shingles), contained_next (estimated share of the text's shingles that the next one has).
    Edited: the last floor(n / 4) characters give way to the first as many (or all) of the next
    document. Two texts without words are alike (1), one without and one with are not (0). A single
    document is its own next; an empty table gives no rows; repeated rows follow one another.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(own)
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - m), F.col("next_text").substr(F.lit(1), m))
    made = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("f"), sketch(edited).alias("e"), sketch(F.col("next_text")).alias("x"),
    )
    f, e, x = F.col("f"), F.col("e"), F.col("x")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(f).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(f, e).alias("near_edited"), resemblance(f, x).alias("near_next"),
        distinct_count(f).alias("n_distinct"), containment(f, x).alias("contained_next"),
    )
