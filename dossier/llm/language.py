"""Language identification with hyperdimensional trigram profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Dimensions of a hypervector. The error of a cosine is about 1 / sqrt(DIMENSIONS).
DIMENSIONS = 1024
#: Key of the letter vectors, and the code points there are.
SEED = 20240229
CODES = 0x110000
#: Possible trigrams up to which a table finds those that occur; beyond it they are sorted.
TABLE = 1 << 24


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(CODES)])


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One random vector of +1 and -1 for every code point, drawn by a keyed hash; 0 stands for the blank."""
    words = C.mix(C.mix(codes.astype(np.uint64)[:, None] + np.uint64(SEED)) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind the letters of every trigram: the first rotated twice, the second once, the third as it is."""
    n = len(letters)
    a, b, c = grams // n**2, grams // n % n, grams % n
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def letter_codes(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the letters of a lower-cased text, every run of other characters as one blank (0)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where(table[code], code, 0)
    keep = np.r_[True, (out[1:] != 0) | (out[:-1] != 0)] if len(out) else np.zeros(0, bool)
    return out[keep]


def bundles(texts: list[str], table: np.ndarray) -> np.ndarray:
    """One bundled vector per text: the sum of its trigram vectors (zero without letters)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    runs = [(n, np.r_[0, x, 0]) for n, x in ((n, letter_codes(t, table)) for n, t in enumerate(texts)) if x.any()]
    if not runs:
        return out
    present = np.zeros(CODES, bool)
    for _, x in runs:
        present[x] = True
    present[0] = True
    codes = np.flatnonzero(present)
    number = np.zeros(CODES, np.int64)
    number[codes] = np.arange(len(codes))
    letters, size = letter_vectors(codes), len(codes)
    row = np.repeat([n for n, _ in runs], [len(x) - 2 for _, x in runs])
    numbers = [number[x] for _, x in runs]
    gram = np.concatenate([x[:-2] * size**2 + x[1:-1] * size + x[2:] for x in numbers])
    if size**3 <= TABLE:
        place = np.zeros(size**3, np.int64)
        place[gram] = 1
        kinds = np.flatnonzero(place)
        place[kinds] = np.arange(len(kinds))
        column = place[gram]
    else:
        kinds, column = np.unique(gram, return_inverse=True)
    for a in range(0, len(kinds), 4096):
        b = min(a + 4096, len(kinds))
        inside = (column >= a) & (column < b)
        counts = np.bincount(row[inside] * (b - a) + column[inside] - a, minlength=len(texts) * (b - a)).reshape(len(texts), b - a)
        out += counts.astype(np.float32) @ gram_vectors(kinds[a:b], letters)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _texts(batch: pa.RecordBatch):
    _, offs = C.buffers(batch.column("text"))
    for start, end in C.pieces(offs):
        for a in range(start, end, 256):
            b = min(a + 256, end)
            yield a, b, [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]


def prototypes(docs: DataFrame) -> list[tuple[str, list[float]]]:
    """One vector per language: the sum of the unit vectors of its training texts.

    Every task adds up what it reads, so one row per task and language is shuffled. What reaches
    the driver is one vector per language.
    """

    def run(batches):
        letters, sums = letter_table(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _texts(batch):
                vectors = unit(bundles(texts, letters))
                for lang in set(langs[a:b]):
                    own = vectors[[i for i, x in enumerate(langs[a:b]) if x == lang]].sum(axis=0, dtype=np.float64)
                    sums[lang] = sums.get(lang, 0) + own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"]
            )

    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("lang", "text")
    parts = known.mapInArrow(run, "lang string, vector array<double>")
    # vectors of a hundred-thousandth, so that the order of adding never shows
    places = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e5).cast("long")).alias("x"))
    rows = places.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return sorted((r.lang, [float(p.x) for p in r.v]) for r in rows.collect())


def identify(docs: DataFrame) -> DataFrame:
    """Language of every text by cosine with the language prototypes.

    In: doc_id, text, lang (NULL: not learned from). Out: doc_id, held_out, lang_pred, score (cosine,
    0 to 1). A text that is NULL or has no letter, and any text if nothing could be learned, is
    ``und`` with score 0. Equal cosines: the first language by name. An empty table gives no rows.
    Letters are those of Unicode, each with a vector of its own, lower-cased; repeated rows each give
    a row, and rows with equal text are learned from as often as they occur. A text counts whole,
    however long; extra columns are ignored.
    """
    learned = prototypes(docs)
    names = [x for x, _ in learned]
    matrix = unit(np.array([v for _, v in learned], np.float64)) if learned else np.zeros((0, DIMENSIONS))
    matrix = matrix.astype(np.float32)

    def run(batches):
        letters = letter_table()
        for batch in batches:
            for a, b, texts in _texts(batch):
                vectors = unit(bundles(texts, letters))
                known = vectors.any(axis=1) if names else np.zeros(len(texts), bool)
                cosine = np.clip(vectors @ matrix.T, 0, 1) if names else np.zeros((len(texts), 1))
                best = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([names[i] if k else "und" for i, k in zip(best.tolist(), known.tolist())], pa.string()),
                        pa.array(np.where(known, cosine.max(axis=1), 0.0).astype(float)),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
