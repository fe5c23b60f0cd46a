"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.session import shared_folder

from . import common as C

#: Id put after every document.
END = 2
#: Text worked on at once, and chunks remembered by a task before its memory is emptied, in bytes.
PIECE = 5 << 20
REMEMBERED = 96 << 20
#: Text of a file; small tables are dealt to the cores in files of SMALL_PART bytes at least.
PART = 48 << 20
SMALL_PART = 4 << 20
#: Layout of the files: bytes of a stripe, rows of an index entry, share of false hits of a Bloom filter.
STRIPE = 16 << 20
STRIDE = 1000
FALSE_HITS = 0.01
# what a byte is, in bits: white space, line end, letter, ASCII mark (but the apostrophe, which may
# begin a pre-token with the letters after it)
_WHITE, _LINE, _LETTER, _MARK = 0, 1, 2, 3
_KINDS = bytes(
    (b in b" \t\n\v\f\r") << _WHITE
    | (9 <= b < 14) << _LINE
    | (65 <= b < 91 or 97 <= b < 123) << _LETTER
    | (33 <= b < 127 and not chr(b).isalnum() and chr(b) != "'") << _MARK
    for b in range(256)
)
# other white space (and controls some engines count as such): texts with these are encoded whole
# (every branch begins with one byte, so that a search skips to the next of these bytes)
_RARE = rb"\x1c|\x1d|\x1e|\x1f|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80|\xef\xbb\xbf"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's encoder behind a memory of chunks (a word or marks, with the white space before).

    Pre-tokens never cross from a word into white space or marks after it, nor from a single line
    end into a word, so a text may be cut there. Texts with special tokens or white space beyond ASCII are
    handed to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.rare = re.compile(b"|".join([_RARE, *(re.escape(s) for s in special)]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # number 0 is the end of a row
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.zeros(1, np.int32)
        self.held = 0

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of distinct chunks in the memory; new ones are encoded by the library."""
        numbers = list(map(self.known.get, chunks))
        if None in numbers:
            fresh = [c for c, n in zip(chunks, numbers) if n is None]
            flat, sizes = array("i"), []
            for e in self.library.encode_batch_fast(fresh, add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                sizes.append(len(ids))
            size = np.array(sizes, np.int64)
            self.known.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
            self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.ids = np.r_[self.ids, np.frombuffer(flat, np.int32)]
            self.held += sum(map(len, fresh)) + 150 * len(fresh)
            numbers = list(map(self.known.get, chunks))
        return np.array(numbers, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row, each followed by ``end``: values and row offsets."""
        if self.held > REMEMBERED:
            self.forget()
        n, rows = len(data), len(offs) - 1
        raw = data.tobytes()
        odd = {int(np.searchsorted(offs, m.start(), "right")) - 1 for m in self.rare.finditer(raw)}
        kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
        flag = lambda k, bit: ((k >> bit) & 1).view(bool)
        del raw
        white = flag(kind, _WHITE)
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        cut[1:] |= flag(kind[:-1], _LETTER) & flag(kind[1:], _MARK)
        cut[2:] |= ~white[:-2] & flag(kind[1:-1], _LINE) & ~white[2:]
        cut[offs[:-1][offs[:-1] < n]] = True
        start = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(np.r_[start, n]), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        number = self.learn(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        # the end is one more chunk of every row
        ends = np.searchsorted(start, offs[1:])
        number = np.insert(number, ends, 0)
        self.ids[0] = end
        del chunks, start, cut, white, kind
        size = self.size[number].astype(np.int32)
        done = np.r_[0, np.cumsum(size, dtype=np.int64)]
        bounds = np.r_[0, done[ends + np.arange(1, rows + 1)]]
        # places fit 32 bits unless one text alone is larger
        source = np.arange(done[-1], dtype=np.int32 if n < 1 << 30 else np.int64)
        source += np.repeat((self.first[number] - done[:-1]).astype(source.dtype), size)
        del number, size, done
        values = self.ids[source]
        del source
        if odd:
            own = np.split(values, bounds[1:-1])
            for r in odd:
                text = data[offs[r] : offs[r + 1]].tobytes().decode()
                own[r] = np.array([*self.library.encode(text, add_special_tokens=False).ids, end], np.int32)
            values, bounds = np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])]
        return values, bounds


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Documents in ascending doc_id (NULL first) over range partitions, with their ids.

    Rows of one doc_id follow by a hash of their text, equal rows by their place in the input, so
    no id needs one task. Out: part, doc_id, start (ids before it in its part), n_tokens, ids.
    """
    path = path or default_vocabulary()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("n")]
    size = int(own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // PART), min(cores, -(-size // SMALL_PART)))
    dealt = own.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, *order)

    def run(batches):
        encoder, part, before = Encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offs = C.buffers(batch.column("text"))
            for a, b in C.pieces(offs, PIECE):
                values, bounds = encoder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, np.int32)),
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(before + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA)


SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> str:
    """Write the ids of all documents as ORC files and give the folder.

    ``tokens`` holds one file a range of doc_id (columns of ``encoded``), rows ascending; integers
    are run-length coded by the format, row indexes hold the least and largest doc_id of every
    ``STRIDE`` rows, Bloom filters its doc_ids, and stripes of ``STRIPE`` bytes are read in
    parallel. ``parts`` holds a row per file: its ids, documents, doc_id range and the ids before it.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    layout = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_HITS, "orc.create.index": "true",
        "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE, "compression": "zstd",
    }
    C.written(encoded(docs, path, end), f"{folder}/tokens", "orc", **layout)
    files = spark.read.schema(SCHEMA).orc(f"{folder}/tokens")
    per_part = files.groupBy("part").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
    )
    # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long"))
    C.written(per_part.withColumn("before", before).coalesce(1), f"{folder}/parts", "orc")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.schema(SCHEMA).orc(f"{folder}/tokens")
    parts = spark.read.schema("part int, before long").orc(f"{folder}/parts")
    return files.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def find(spark: SparkSession, folder: str, doc_ids: Sequence[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups that cannot hold them are not read."""
    return read_tokens(spark, folder).where(F.col("doc_id").isin(list(doc_ids)))


def token_digests(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Write the ids of all documents, read the files back and give one row per document.

    In: doc_id, text (NULL: empty); other columns are ignored. Out: doc_id, start, n_tokens (with
    the end id), ids_crc32 (of the ids as little-endian 32-bit numbers). An empty text holds the
    end id alone; rows with a NULL doc_id come first; a repeated doc_id keeps all its rows; a long
    text is one row of any length; an empty table gives no rows.
    """
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = np.asarray(ids.flatten()).astype("<i4", copy=False)
            bounds = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    back = read_tokens(docs.sparkSession, write_tokens(docs, path=path, end=end))
    return back.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
