"""Set-similarity join of documents on word shingles with PartEnum signatures."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
#: 64-bit words of the parity sketch of a set.
_SKETCH = 8
#: Keys of a signature beyond which it counts as crowded.
HOT = 16
#: Up to this Hamming distance the signatures are subsets of parts, beyond it single parts.
_ENUMERATED = 7


# plain tables, as wrapped functions would be looked up by name on executors without this package
_bands: dict[tuple[int, int, int], tuple[tuple[int, int, int], ...]] = {}
_layouts: dict[tuple[int, int], tuple[int, int]] = {}


def bands(size: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """Size bands (number, lowest size, Hamming bound) a set of ``size`` elements takes part in.

    A pair of similarity num/den or more has its smaller set in [low, high] of some band and its
    larger one at most high * den / num; both carry the signatures of that band. Two sets of a
    and b elements then differ in at most (a + b) * (den - num) / (den + num) elements.
    """
    if (size, num, den) in _bands:
        return _bands[size, num, den]
    out, low, number = [], 1, 0
    while low <= size:
        high = max(low, math.ceil(low * 1.5) - 1)
        reach = high * den // num
        if size <= reach:
            out.append((number, low, (high + reach) * (den - num) // (den + num)))
        low, number = high + 1, number + 1
    if len(_bands) > 1 << 14:
        _bands.clear()
    _bands[size, num, den] = tuple(out)
    return _bands[size, num, den]


def layout(low: int, k: int) -> tuple[int, int]:
    """Number of parts and number of parts that may be empty without notice.

    With k + 1 + e parts at least e + 1 parts of a similar pair are equal, so one equal part
    holds elements if either set has at most e empty parts. Sets with more (rare: e lies two
    above the mean by 2.5 deviations) also carry the signatures of their empty parts.
    """
    if (low, k) in _layouts:
        return _layouts[low, k]
    e = 0
    while e < 2 * k:
        n = k + 1 + e
        p = (1 - 1 / n) ** low
        if e >= 2 + n * p + 2.5 * math.sqrt(n * p * (1 - p)):
            break
        e += 1
    _layouts[low, k] = k + 1 + e, e
    return _layouts[low, k]


def signatures(values: np.ndarray, offs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and note of every signature of the sets (rows of distinct hashes).

    note = band << 20 | 1 + s: any s parts that hold elements can be left out, and one of the
    others is still equal in every similar set; 0 below the shift where none can.
    """
    sizes = np.diff(offs)
    members: dict[tuple[int, int, int], list[int]] = {}
    for r, size in enumerate(sizes.tolist()):
        for band in bands(size, num, den):
            members.setdefault(band, []).append(r)
    rows, sigs, notes = [], [], []
    for (number, low, k), own in members.items():
        own = np.array(own)
        if k == 0:
            # only equal sets can be similar in this band, and those share their key
            continue
        count = sizes[own]
        at = np.repeat(offs[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        v = values[at]
        who = np.repeat(np.arange(len(own)), count)
        parts, spare = (max(4, k + 2), 0) if k <= _ENUMERATED else layout(low, k)
        part = (C.mix(v ^ U(0xA5A5_0000 + number)) >> U(33)).astype(np.int64) % parts
        cell = who * parts + part
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sums = np.zeros(len(own) * parts, U)
        sums[cell[first]] = np.add.reduceat(C.mix(v[order] + U(number)), first)
        sums = sums.reshape(len(own), parts)
        if k <= _ENUMERATED:
            for c, chosen in enumerate(itertools.combinations(range(parts), parts - k)):
                rows.append(own)
                notes.append(np.full(len(own), number << 20))
                sigs.append(C.mix(sums[:, list(chosen)].sum(axis=1) + U((number << 20) + c + 1)))
        else:
            empty = np.ones(sums.size, bool)
            empty[cell[first]] = False
            empty = empty.reshape(sums.shape)
            keep = ~empty | (empty.sum(axis=1) > spare)[:, None]
            r, p = np.nonzero(keep)
            rows.append(own[r])
            notes.append((number << 20) + np.maximum(0, (~empty).sum(axis=1) - k)[r])
            sigs.append(C.mix(C.mix(sums[r, p]) + U(number << 32) + p.astype(U)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(notes)


def _set_keys(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for the empty set."""
    sizes = np.diff(offs)
    out = np.zeros(len(sizes), U)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = C.mix(np.add.reduceat(C.mix(values), offs[full]) + sizes[full].astype(U))
    return out.view(np.int64)


def _parities(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per set 512 bits, each the parity of the elements hashed to it.

    Two sets that differ in d elements differ in at most d bits, so the sketch rules a pair out
    without error.
    """
    rows, width = len(offs) - 1, 64 * _SKETCH
    bit = (C.mix(values + U(77)) >> U(40)).astype(np.int64) % width
    odd = np.bincount(np.repeat(np.arange(rows), np.diff(offs)) * width + bit, minlength=rows * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, width), axis=1).view(np.int64)


def _sets(batch: pa.RecordBatch):
    data, offs = C.buffers(batch.column("text"))
    for a, b in C.pieces(offs):
        values, at = C.shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        yield a, b, values, at


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a key that is equal for equal shingle sets (NULL for the empty set), sketch p0..p7."""
    sketch = [f"p{i}" for i in range(_SKETCH)]

    def run(batches):
        for batch in batches:
            for a, b, values, at in _sets(batch):
                n = np.diff(at)
                parity = _parities(values, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(_set_keys(values, at), mask=n == 0)]
                    + [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(_SKETCH)],
                    ["doc_id", "n_shingles", "key", *sketch],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key long, " + ", ".join(f"{c} long" for c in sketch))


def _signature_rows(docs: DataFrame, num: int, den: int) -> DataFrame:
    """sig, key, note; a set met again within a task is left out, as its rows would be the same."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, values, at in _sets(batch):
                keys = _set_keys(values, at)
                fresh = [i for i, k in enumerate(keys.tolist()) if k not in seen and not seen.add(k)]
                keys, count = keys[fresh], np.diff(at)[fresh]
                start = np.r_[0, np.cumsum(count)]
                values = values[np.repeat(at[fresh] - start[:-1], count) + np.arange(start[-1])]
                row, sig, note = signatures(values, start, num, den)
                columns = sig.view(np.int64), keys[row], note.astype(np.int32)
                for i in range(0, len(sig), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in columns], ["sig", "key", "note"])

    return docs.select("text").mapInArrow(run, "sig long, key long, note int")


def _set_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, values, at in _sets(batch):
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), raw.cast(pa.binary())], ["key", "elements"])

    return docs.select("key", "text").mapInArrow(run, "key long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets have intersection / union >= num / den."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            keep = []
            for left, right in zip(x, y):
                s, t = (np.frombuffer(v.as_buffer(), U) for v in (left, right))
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                same = int((t[at] == s).sum())
                keep.append(den * same >= num * (len(s) + len(t) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _not_ruled_out(num: int, den: int):
    """Condition on the sizes and parity sketches a_*, b_* of a pair that every similar pair meets."""
    apart = sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(_SKETCH)), F.lit(0))
    small, large = F.least("a_n_shingles", "b_n_shingles"), F.greatest("a_n_shingles", "b_n_shingles")
    return (den * small >= num * large) & ((den + num) * apart <= (den - num) * (small + large))


def _named(sizes: DataFrame, side: str) -> DataFrame:
    names = ["n_shingles", *(f"p{i}" for i in range(_SKETCH))]
    return sizes.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in names))


def _possible(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches do not rule out."""
    return pairs.join(_named(sizes, "a"), "a").join(_named(sizes, "b"), "b").where(_not_ruled_out(num, den)).select("a", "b")


def _rest(placed: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of keys in different components that share a signature and are not ruled out.

    placed: sig, key, note, r (component). A signature of more than HOT keys mostly spells a
    passage that many texts share. A key whose crowded signatures in a band are no more than the
    parts it can leave out (its note) meets every similar key under another signature, so it stays
    away from the crowded ones; only keys made up of such passages compare there.
    """
    band = F.col("note").bitwiseAND(F.lit(~0xFFFFF))
    groups = placed.groupBy("sig").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.count("*").alias("n")).where("r1 < r2")
    open_ = placed.join(groups.select("sig", "n"), "sig").withColumn("band", band).withColumn("spare", F.col("note") - F.col("band"))
    crowded = open_.where(F.col("n") > HOT)
    bound = crowded.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("spare").alias("s")).where("c >= s").select("key", "band")
    left = C.stored(open_.where(F.col("n") <= HOT).select("sig", "key", "r").union(crowded.join(bound, ["key", "band"], "left_semi").select("sig", "key", "r")), "rest")
    still = left.groupBy("sig").agg(F.min("r").alias("r1"), F.max("r").alias("r2")).where("r1 < r2").select("sig")
    left = left.join(still, "sig", "left_semi")
    one = left.withColumnsRenamed({"key": "a", "r": "ra"}).join(_named(sizes, "a"), "a")
    two = left.withColumnsRenamed({"key": "b", "r": "rb"}).join(_named(sizes, "b"), "b")
    met = one.join(two, (one["sig"] == two["sig"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _not_ruled_out(num, den))
    return met.select("a", "b").distinct()


def jaccard_components(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents whose five-word shingle sets have Jaccard similarity >= num/den.

    In: any table with ``doc_id`` (no NULLs, repeated only with equal text) and ``text``; other columns are ignored.
    Out: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).
    A text without words (NULL, empty, white space) has no shingle and is linked with nothing;
    equal texts are one component; an empty table gives no rows.

    Exact: (1) equal sets collapse to one key; (2) PartEnum signatures bring every similar pair
    of keys together; (3) of each signature only keys met by another key are kept, with the
    smallest key of the group as pivot; (4) sizes and parity sketches rule candidates out, the
    others are verified on the whole sets in three rounds: one pivot per key, then every pivot of
    another component and the group's largest and preceding key, then every remaining pair of keys that share a signature and still lie in
    different components (see ``_rest``). Families of near copies collapse in the first two rounds, so no round
    emits the pairs within a family.
    """
    from pyspark.sql import Window

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = C.stored(set_keys(base), "set-keys")
    group = Window.partitionBy("sig")
    shared = C.stored(
        _signature_rows(base, num, den)
        .select("sig", "key", "note", F.min("key").over(group).alias("lo"), F.max("key").over(group).alias("hi"), F.lag("key").over(group.orderBy("key")).alias("prev"))
        .where("lo < hi").withColumn("prev", F.when(F.col("prev") < F.col("key"), F.col("prev"))).groupBy("sig", "key", "note", "lo", "hi").agg(F.max("prev").alias("prev")),
        "shared-signatures",
    )
    sizes = keys.where("key is not null").drop("doc_id").dropDuplicates(["key"])
    pivots = C.stored(_possible(shared.where("lo < key").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct(), sizes, num, den), "pivots")

    def sets_of(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        first = keys.join(used, "key").groupBy("key", "doc_id").count().groupBy("key").agg(F.min(F.struct("doc_id", "count")).alias("m")).select("key", "m.*")
        held = base.join(first, "doc_id").select("key", "text", "count")
        # of rows repeated in full one set is enough
        once, several = held.where("count = 1"), held.where("count > 1").dropDuplicates(["key"])
        return C.stored(_set_rows(once.union(several)), "sets")

    sets = sets_of(pivots)
    tested = C.stored(pivots.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tested")
    links = C.stored(_verified(tested, sets, num, den), "links")
    roots = C.stored(C.components(links), "roots")

    def rooted(df: DataFrame, key: str, root: str) -> DataFrame:
        own = roots.select(F.col("node").alias(key), F.col("root").alias(root))
        return df.join(own, key, "left").withColumn(root, F.coalesce(root, key))

    apart = rooted(rooted(pivots, "a", "r"), "b", "s").where("r <> s").select("a", "b")
    second = C.stored(apart.join(tested, ["a", "b"], "left_anti"), "tested")
    more = C.stored(_verified(second, sets, num, den), "links")
    tested, links = tested.union(second), links.union(more)
    roots = C.stored(C.components(links), "roots")

    # two more partners of every key: the largest key of the group and the one before it
    other = shared.select(F.explode(F.array(F.struct(F.col("key").alias("a"), F.col("hi").alias("b")), F.struct(F.col("prev").alias("a"), F.col("key").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b")
    other = rooted(rooted(other, "a", "r"), "b", "s").where("r <> s").select("a", "b").distinct()
    fourth = C.stored(_possible(other.join(tested, ["a", "b"], "left_anti"), sizes, num, den), "tested")
    if not fourth.isEmpty():
        links = links.union(C.stored(_verified(fourth, sets_of(fourth), num, den), "links"))
        roots = C.stored(C.components(links), "roots")
        tested = tested.union(fourth)

    rest = _rest(rooted(shared.select("sig", "key", "note"), "key", "r"), sizes, num, den)
    third = C.stored(rest.join(tested, ["a", "b"], "left_anti"), "tested")
    if not third.isEmpty():
        links = links.union(C.stored(_verified(third, sets_of(third), num, den), "links"))
        roots = C.components(links)

    placed = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component only the row with the smallest doc_id stays.

    Rows are told apart by doc_id and text, so a NULL or repeated doc_id is a row like any other
    (NULL comes last); of rows equal in both one stays. Texts without words are all kept.
    """
    row = "_row" + "_" * max(map(len, docs.columns))
    named = docs.withColumn(row, C.row_key())
    own = named.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").alias("given"))
    parts = jaccard_components(own).where("n_shingles > 0").distinct()
    given = own.select("doc_id", F.col("given").cast("long").alias("given")).groupBy("doc_id").agg(F.min("given").alias("given"), F.count("*").alias("n"))
    known = C.stored(given.join(parts, "doc_id", "left"), "rows-of-components")
    order = F.struct(F.col("given").isNull(), "given", "doc_id")
    first = known.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct(order.alias("o"), "n")).alias("m")).select(F.col("m.o.doc_id").alias(row), F.col("m.n").alias("n"))
    bare = known.where("component_id is null").select(F.col("doc_id").alias(row))
    once = named.join(first.where("n = 1").select(row).union(bare), row, "left_semi")
    several = named.join(first.where("n > 1").select(row), row, "left_semi").dropDuplicates([row])
    return once.union(several).select(docs.columns)
