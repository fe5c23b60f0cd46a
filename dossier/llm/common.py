"""Shared pieces: tables, the shared work folder, Arrow batches as byte arrays, word shingles, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import shared_folder

#: Bytes of text worked on at once inside a task (a longer single text is one piece of its own).
PIECE = 1 << 20
WORDS = 5
U = np.uint64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the folder named by ``spark.checkpoint.dir`` and go on from the files.

    The folder must be one that driver and executors share: without the setting a local session
    gets a temporary folder (tests) and a cluster is refused. The shuffle files of the job are
    dropped when the table is written, as later jobs read the table alone.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, form: str, **options) -> None:
    """Write ``df`` to ``path`` and drop the shuffle files of the job, as later jobs read the files alone."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.format(form).options(**options).save(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def row_key():
    """One number per doc_id and text, for rows whose doc_id may be NULL or repeated."""
    given, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(text, given, given.isNull(), text.isNull())


# ---------------------------------------------------------------- Arrow text columns as bytes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row offsets; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            out = np.ones(size, U)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = out
    return _powers["p"], _powers["i"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, so that any stretch has a hash in two look-ups."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * p[: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(_ODD))


# ---------------------------------------------------------------- words and shingles

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row, word_hashes(_LOWER[data], start, end)


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every stretch ``data[start:end]`` (none empty): its pieces of 8 bytes, each mixed with its place, added up.

    Mixing before adding keeps the hash free of the algebra by which polynomials modulo 2^64 give
    long regular strings one value.
    """
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    count = (size + 7) // 8
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    piece = eight[np.repeat(start, count) + 8 * place]
    last = first + count - 1
    piece[last] &= _TAIL[size - 8 * (count - 1) - 1]
    value = mix(mix(piece ^ U(_BASE)) + (place + 1).astype(U) * U(_ODD))
    return mix(np.add.reduceat(value, first) + size.astype(U) * U(_ODD))


def shingles(row: np.ndarray, h: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``width``-word shingle; a row with fewer words is one shingle."""
    factors = [U(pow(_ODD, k + 1, 1 << 64)) for k in range(width)]
    n = len(h) - width + 1
    if n > 0:
        full = row[:n] == row[width - 1 :]
        value = np.zeros(n, U)
        for k, f in enumerate(factors):
            value += h[k : k + n] * f
        rows, values = [row[:n][full]], [mix(value[full])]
    else:
        rows, values = [row[:0]], [h[:0]]
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, len(row)])
        for m in range(1, width):
            at = first[count == m]
            value = np.full(len(at), m, U)
            for k in range(m):
                value += h[at + k] * factors[k]
            rows.append(row[at])
            values.append(mix(value))
    return np.concatenate(rows), np.concatenate(values)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ordered by row and value, and the row offsets into them."""
    _, _, row, h = words(data, offs)
    rows, values = shingles(row, h, width)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        new = np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]
        rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(offs)))


# ---------------------------------------------------------------- components


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """Smallest reachable vertex of every vertex in ``links(a, b)``: columns node, root.

    Alternating stars: every vertex hands its smallest neighbour to its larger, then to its
    smaller neighbours. Each pass is two map-side combined minima and two joins; the number of
    passes grows with the logarithm of the longest path. Passes are written to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), purpose
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = stored(small, purpose)
        same = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same == new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            break
        edges = new
    roots = new.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
