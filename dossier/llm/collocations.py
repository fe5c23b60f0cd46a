"""Collocations: phrases mined shard by shard at lowered support, counted exactly, scored and ranked."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Text and words of a shard; a task holds one shard at about 45 bytes a word.
SHARD_BYTES = 16 << 20
SHARD_WORDS = 4_000_000
#: Words counted at once in the last pass, where the size of a shard does not matter.
COUNTED_WORDS = 1_000_000
#: Text of a task in that pass, and phrases it holds before it hands them on.
COUNTED_BYTES = 64 << 20
HELD = 1_000_000
#: Occurrences from which a shard reports a phrase, where its share of the support is not less.
LOCAL = 2
PIECE = 4 << 20
ROWS = 500
#: Bits of the map that marks locally frequent phrases: 16 MB whatever the input.
BITS = 1 << 27
U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class Shard:
    """Words of some documents as numbers, with their language and whether the next word is in the same piece."""

    def __init__(self):
        self.number: dict[str, dict[str, int]] = {}
        self.hashes = array("Q")
        self.codes: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        self.size = self.weight = 0

    def add(self, data: np.ndarray, offs: np.ndarray, langs: list[str]) -> None:
        self.weight += len(data)
        stop = _STOP[data]
        inside = ~(_GAP[data] | stop)
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            return
        row = np.searchsorted(offs, start, "right") - 1
        piece = np.cumsum(stop, dtype=np.int32)[start] + row
        bounds = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(C._LOWER[data[inside]])).dictionary_encode()
        # a word of one language is another number than the same word of the next
        lang, named = pd.factorize(np.array(langs, object))
        own, pairs = pd.factorize(lang[row] * len(words.dictionary) + words.indices.to_numpy())
        distinct, known = words.dictionary.to_pylist(), []
        tables = [(self.number.setdefault(x, {}), xxhash.xxh3_64_intdigest(x)) for x in named.tolist()]
        for pair in pairs.tolist():
            (table, seed), word = tables[pair // len(distinct)], distinct[pair % len(distinct)]
            at = table.get(word)
            if at is None:
                at = table[word] = len(self.hashes)
                self.hashes.append(xxhash.xxh3_64_intdigest(word, seed))
            known.append(at)
        self.codes.append(np.array(known, np.int32)[own])
        self.joined.append(np.r_[piece[1:] == piece[:-1], False])
        self.size += len(start)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > 1:
            self.codes, self.joined = [np.concatenate(self.codes)], [np.concatenate(self.joined)]
        return self.codes[0], self.joined[0]

    def phrases(self, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Kept phrases by length: words, places of first occurrence, counts and hashes.

        ``keep`` decides by length, hash and count. A phrase is counted only where both phrases of one
        word less are kept, as none occurs more often than its parts. Numbers of phrases are exact:
        a phrase is the pair of its two parts.
        """
        if not self.size:
            return
        codes, joined = self.whole()
        hashed = np.frombuffer(self.hashes, U)
        at, key = np.arange(len(codes), dtype=np.int32), codes
        number = np.empty(len(codes), np.int32)
        for k in range(1, longest + 1):
            if k > 1:
                more = number[:-1] >= 0
                more &= number[1:] >= 0
                if k == 2:
                    more &= joined[:-1]
                at = np.flatnonzero(more).astype(np.int32)
                key = number[at].astype(np.int64) * len(hashed)
                key += number[at + 1]
            if not len(at):
                return
            # equal keys side by side, each run in the order of the text
            order = np.argsort(key, kind="stable")
            key = key[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            at = at[order]
            del key, order
            count, first = np.diff(np.r_[start, len(at)]), at[start]
            if k == 1:
                h = hashed[codes[first]]
            else:
                h = C.mix(hashed[number[first]] * U(0x9E3779B97F4A7C15) + C.mix(hashed[number[first + 1]]))
            kept = keep(k, h, count)
            number = np.full(len(codes), -1, np.int32)
            number[at] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32), count)
            hashed = h[kept]
            yield k, first[kept], count[kept], hashed

    def counts(self, marked: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
        """Counts of marked phrases, and per language all words (phrase NULL)."""
        if not self.size:
            return
        codes, _ = self.whole()
        words, langs = [""] * len(self.hashes), np.zeros(len(self.hashes), np.int32)
        for i, table in enumerate(self.number.values()):
            for word, at in table.items():
                words[at], langs[at] = word, i
        names, words = pa.array(list(self.number), pa.string()), pa.array(words, pa.large_string())
        each = np.bincount(langs[codes], minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array(each)], _COUNTED)
        for k, first, count, _ in self.phrases(lambda k, h, count: is_marked(marked, h), longest):
            for a in range(0, len(first), 100_000):
                at = first[a : a + 100_000]
                texts = [words.take(pa.array(codes[at + i])) for i in range(k)]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if k > 1 else texts[0]
                columns = [names.take(pa.array(langs[codes[at]])), phrase.cast(pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(count[a : a + 100_000].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, _COUNTED)


_COUNTED = ["lang", "phrase", "k", "f"]


def is_marked(marked: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & U(len(marked) * 8 - 1)
    return (marked[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1


def shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Shard]:
    """The documents of a task as shards of at least ``words`` words (the last one: what is left)."""
    shard = Shard()
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            some = batch.slice(begin, ROWS)
            data, offs = C.buffers(some.column("text"))
            langs = some.column("lang").to_pylist()
            for a, b in C.pieces(offs, PIECE):
                shard.add(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], langs[a:b])
                if shard.size >= words:
                    yield shard
                    shard = Shard()
    yield shard


def summed(counts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of equal phrases added up, ``most`` phrases at a time, so that few rows are shuffled."""
    def added() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(_COUNTED[:3], use_threads=False).aggregate([("f", "sum")])
        return table.rename_columns(_COUNTED).to_batches(max_chunksize=100_000)

    held, rows = [], 0
    for batch in counts:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            held = added()
            rows = sum(map(len, held))
            if rows >= most // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from added()


def _mark(own: DataFrame, marked: np.ndarray, levels: range, support: int, weight: int, shard_words: int, local: int) -> np.ndarray:
    """The map with the phrases of some lengths added that may reach the support.

    Every shard mines its phrases of at least ``least`` occurrences completely and hands on how far
    each exceeds ``least`` - 1; shards that say nothing of a phrase hold that many at most. So a
    phrase stays possible while its excess and the sum of all ``least`` - 1 reach the support.
    """
    known = own.sparkSession.sparkContext.broadcast(marked)

    def mine(batches):
        for shard in shards(batches, shard_words):
            # the proportional share of the support, or less of it: smaller counts bound the total better
            least = max(1, min(local, -(-support * shard.weight // max(weight, 1))))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([least - 1])], ["h", "more"])

            def keep(k, h, count):
                return count >= least if k >= levels.start else is_marked(known.value, h)

            for k, _, count, h in shard.phrases(keep, levels.stop - 1):
                if k >= levels.start:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count.astype(np.int64) - (least - 1))], ["h", "more"])

    bounds = C.stored(own.mapInArrow(mine, "h long, more long").groupBy("h").agg(F.sum("more").alias("more")), "phrase-bounds")
    slack = bounds.where("h is null").agg(F.sum("more")).first()[0] or 0
    bits = len(marked) * 8
    bit = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    possible = bounds.where("h is not null").where(F.col("more") >= support - slack).select(bit.alias("bit"))
    maps = possible.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    out = np.zeros(max(len(marked), 4096), np.uint8)
    # as many rows as the map has stretches of 4096 bytes
    for r in maps.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.map, np.uint8)
    return out[: len(marked)] | marked


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_words: int = SHARD_WORDS, bits: int = BITS, local: int = LOCAL) -> DataFrame:
    """Exact counts of all phrases of up to ``longest`` words that occur ``support`` times in a language.

    Out: lang, phrase, k, f; phrase NULL with k 0 counts all words of the language. A shard holding
    the share w of all text mines every phrase that occurs at least w * support times in it, or
    ``local`` times where that is less: first words and pairs, then longer phrases whose pairs are
    all possible. The union over the shards is kept as a map of ``bits`` hash bits (fixed size; a
    clash only brings one more phrase to count). The last pass counts the marked phrases of every
    shard, and the sums decide.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    weight = int(own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    # large shards keep the local support high: as many as the memory of a task asks for, or the cores
    cores = docs.sparkSession.sparkContext.defaultParallelism
    least = min(cores, -(-weight // PIECE))
    mined = own.coalesce(max(1, -(-weight // SHARD_BYTES), least))
    marked = np.zeros(bits // 8, np.uint8)
    for levels in (range(1, 3), range(3, longest + 1)):
        marked = _mark(mined, marked, levels, support, weight, shard_words, local)
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def count(batches):
        found = (c for shard in shards(batches, min(shard_words, COUNTED_WORDS)) for c in shard.counts(shared.value, longest))
        yield from summed(found, HELD)

    counted = own.coalesce(max(1, -(-weight // COUNTED_BYTES), least)).mapInArrow(count, "lang string, phrase string, k int, f long")
    return C.stored(counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(f"k = 0 or f >= {int(support)}"), "phrases")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int | None = TOP, shard_words: int = SHARD_WORDS, bits: int = BITS, local: int = LOCAL) -> DataFrame:
    """The best phrases of every language by how far they exceed their parts.

    In: lang (NULL: ``und``), text (NULL: empty); other columns are ignored, repeated rows count
    again. Texts are cut at ``.,;:!?`` and line ends, phrases stay inside a cut. Candidates: 2 to
    ``longest`` words, at least ``support`` occurrences. Out: lang, rank, phrase, a (its count), l
    and r (of the two parts at the lowest-scoring cut, the first of equal ones), n (words of the
    language), score = floor(1000 a n / (l r)). A candidate inside a longer one as frequent is left
    out. Order: score and a descending, phrase in byte order; the first ``top`` of each language
    (None: all). Long texts are one row of any length; an empty table gives no rows. Products are
    exact up to 38 digits.
    """
    counted = frequent_phrases(docs, support, longest, shard_words, bits, local)
    known = counted.where("k > 0").select("lang", "phrase", "f")
    phrases = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(w, cut + 1, k), ' ')").alias("tail"),
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    totals = counted.where("k = 0").select("lang", F.col("f").alias("n"))
    big = "cast({} as decimal(19, 0))".format
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang").withColumn(
        "score", F.expr(f"(1000 * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})")
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # as a part occurs no less often than the whole, one word more settles containment in any longer phrase
    inner = phrases.where("k > 2").select(
        "lang", F.explode(F.array(F.expr("array_join(slice(w, 1, k - 1), ' ')"), F.expr("array_join(slice(w, 2, k), ' ')"))).alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {longest + 1}) r(k))),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {support}),
parts AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM freq WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f), c.cut) AS pos
  FROM parts c JOIN totals n ON n.lang = c.lang
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.cut], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
kept AS (
  SELECT * FROM scored c WHERE pos = 1 AND NOT EXISTS (
    SELECT 1 FROM freq x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.f >= 100 * c.a AND contains(concat(' ', x.phrase, ' '), concat(' ', c.phrase, ' ')))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
