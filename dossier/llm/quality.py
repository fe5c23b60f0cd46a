"""Quality score from the sizes that good and bad zstandard dictionaries compress a text to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bytes compressed at once: a dictionary helps every part of a long text alike.
BLOCK = 4096
#: Labelled rows per class that the dictionaries are built from, and that the score is calibrated on.
DICTIONARY_ROWS = 1500
CALIBRATION_ROWS = 3000
#: Bytes of a dictionary, and of what one row may give to it.
DICTIONARY_BYTES = 256 << 10
SHARE_BYTES = 1024
LEVEL = 7
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _compressor(content: bytes):
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(text: bytes, good, bad) -> tuple[int, int, int]:
    """Bytes of a text, and what its blocks take with the good and with the bad dictionary."""
    g = b = 0
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return len(text), g, b


def features(n: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised compressed-size difference (above 0: nearer to good texts) and compression, each also by length."""
    size = np.log1p(n)
    d = (b - g) / np.maximum(np.maximum(b, g), 1)
    r = np.minimum(g, b) / np.maximum(n, 1)
    return np.stack([np.ones_like(d), d, d * size, size, r, r * size], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(df: DataFrame, good_bytes: bytes, bad_bytes: bytes, column: str) -> DataFrame:
    """``df`` with one more column, the three sizes of its text; all other columns pass as they are."""

    def run(batches):
        good, bad = _compressor(good_bytes), _compressor(bad_bytes)
        for batch in batches:
            data, offs = C.buffers(batch.column("text"))
            out = np.zeros((batch.num_rows, 3), np.int64)
            for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                out[r] = sizes(data[a:b].tobytes(), good, bad)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * batch.num_rows + 1, 3), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.LongType()))]))


def train(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, list[float], float]:
    """Dictionaries, calibration and share of good rows, from labelled rows outside the held-out fold.

    A bounded sample: of each class the DICTIONARY_ROWS rows that come first by a hash of doc_id
    give SHARE_BYTES characters each to the dictionary, the next CALIBRATION_ROWS their sizes to
    the calibration, whose odds are then set to those of all labelled rows.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    marked = marked.where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text")
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    flat = [float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0, 0.0, 0.0, 0.0]
    if not counts.get(0) or not counts.get(1):
        return b"", b"", flat, share
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = marked.select("doc_id", "y", F.row_number().over(order).alias("n")).where(F.col("n") <= DICTIONARY_ROWS + CALIBRATION_ROWS)
    cut = {y: min(DICTIONARY_ROWS, max(1, counts[y] // 2)) for y in (0, 1)}
    first = F.col("n") <= F.when(F.col("y") == 1, cut[1]).otherwise(cut[0])
    # at most 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS) short rows
    sample = C.stored(texts.join(F.broadcast(drawn), "doc_id").withColumn("first", first), "labelled-sample")
    room = F.greatest(F.length("text") - SHARE_BYTES + 1, F.lit(1))
    shares = (
        sample.where("first")
        .select("y", "n", F.col("text").substr((F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(SHARE_BYTES)).alias("part"))
        .orderBy("n", "part").collect()
    )
    content = {}
    for y in (0, 1):
        own = [r.part.encode() for r in shares if r.y == y]
        each = max(64, DICTIONARY_BYTES // max(1, len(own)))
        content[y] = b"\n".join(x[:each] for x in own)[:DICTIONARY_BYTES]
    rows = _measured(sample.where("not first"), content[1], content[0], "sizes").select("y", "sizes").collect()
    y = np.array([r.y for r in rows], float)
    if not 0 < y.sum() < len(y):
        return content[1], content[0], flat, share
    w = calibrate(features(*np.array([r.sizes for r in rows], float).T), y)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return content[1], content[0], w.tolist(), share


def _probability(sizes: Column, w: list[float], share: float) -> Column:
    n, g, b = (sizes[i].cast("double") for i in range(3))
    size, d, r = F.log1p(n), (b - g) / F.greatest(b, g, F.lit(1.0)), F.least(g, b) / F.greatest(n, F.lit(1.0))
    x = F.lit(w[0]) + w[1] * d + w[2] * d * size + w[3] * size + w[4] * r + w[5] * r * size
    return F.when(n > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))).otherwise(F.lit(share))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Calibrated probability that a text is good.

    In: ``documents`` (doc_id, text) and ``labels`` (doc_id, quality 0/1; other values and NULLs are
    ignored, of repeated rows the best counts). Out: doc_id, held_out, score, predicted (1 from 0.3
    on). The whole text is compressed in blocks. NULL and empty texts get the share of good rows;
    without labels of both classes every text gets that share; an empty table gives no rows.
    """
    good, bad, w, share = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _measured(own, good, bad, "sizes").select("doc_id", _probability(F.col("sizes"), w, share).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the others pass with all their columns."""
    good, bad, w, share = train(docs, labels)
    column = "_sizes" + "_" * max(map(len, docs.columns))
    return _measured(docs, good, bad, column).where(_probability(F.col(column), w, share) >= THRESHOLD).drop(column)
