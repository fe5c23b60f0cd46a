"""Removal of repeated byte strings with suffix arrays built by induced sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
#: Shortest string that counts as repeated, and the width of the anchors inside it.
MIN_BYTES = 400
ANCHOR = 64
#: Bytes of text that one suffix array covers.
SHARD_BYTES = 1 << 21
#: Pieces of an anchor beyond which they would overfill a shard; see ``_crowded_marks``.
CROWDED = 2000
_GAP = 255  # no byte of UTF-8 text

# ---------------------------------------------------------------- suffix arrays


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S type); the last is, as if an end mark followed."""
    n = len(s)
    up = np.ones(n, bool)
    if n > 1:
        d = np.sign(s[1:].astype(np.int64) - s[:-1])
        nz = np.flatnonzero(d)
        # equal neighbours follow the next change; a run up to the end counts as falling to the end mark
        after = np.searchsorted(nz, np.arange(n - 1))
        up[:-1] = np.where(after < len(nz), d[nz[np.minimum(after, len(nz) - 1)]] > 0, False) if len(nz) else False
    up[-1] = False
    return up


def _induce(s: np.ndarray, up: np.ndarray, seeds: np.ndarray, buckets: int) -> np.ndarray:
    """Suffix array induced from ordered leftmost-smaller suffixes, bucket by bucket.

    Larger suffixes are filled in from the front, then smaller ones from the back. A bucket is
    worked on as a whole: the predecessors of its entries are dealt to their buckets in order, and
    again for the entries this adds to the bucket itself.
    """

    def deal(lists: list[list[np.ndarray]], before: np.ndarray) -> None:
        if not len(before):
            return
        c = s[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order], before[order]
        at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(c)]):
            lists[c[a]].append(before[a:b])

    n = len(s)
    starts = [[] for _ in range(buckets)]
    deal(starts, seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    large[s[n - 1]].append(np.array([n - 1]))  # the end mark comes first of all
    for c in range(buckets):
        done = 0
        while done < len(large[c]):
            part = large[c][done] - 1
            done += 1
            part = part[part >= 0]
            part = part[~up[part]]
            deal(large, part)
        for part in starts[c]:
            part = part - 1
            part = part[part >= 0]
            part = part[~up[part]]
            deal(large, part)
    small: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    for c in range(buckets - 1, -1, -1):
        done = 0
        while done < len(small[c]):
            part = small[c][done] - 1
            done += 1
            part = part[part >= 0]
            part = part[up[part]]
            deal(small, part)
        for part in reversed(large[c]):
            part = part[::-1] - 1
            part = part[part >= 0]
            part = part[up[part]]
            deal(small, part)
    out = []
    for c in range(buckets):
        out += large[c]
        out += [p[::-1] for p in reversed(small[c])]
    return np.concatenate(out)


def _ranked(names: np.ndarray) -> np.ndarray:
    """Suffix array of a reduced string: ranks of stretches of 1, 2, 4, ... names until all differ."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    n, width = len(names), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + second
        kinds, new = np.unique(key, return_inverse=True)
        rank, width = new.astype(np.int64) + 1, width * 2
        if len(kinds) == n or width >= n:
            return np.argsort(rank, kind="stable")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string (the end counts as smaller than every byte).

    Leftmost-smaller substrings are sorted by one induction and named; the reduced string of names
    is sorted; its order seeds the second induction, which yields all suffixes.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint8)
    up = types(s)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(lms) > 1:
        first = _induce(s, up, lms, 256)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = first[is_lms[first]]
        end = np.full(n, n, np.int64)
        end[lms[:-1]] = lms[1:] + 1
        sums = C.prefix_sums(s)
        value = C.stretch(sums, ordered, end[ordered])
        new = np.r_[True, value[1:] != value[:-1]]
        names = np.zeros(n, np.int64)
        names[ordered] = np.cumsum(new)
        reduced = names[lms]
        lms = ordered if new.all() else lms[_ranked(reduced)]
    return _induce(s, up, lms, 256)


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes: for every position the length, up to ``cap``, shared with the suffix before it in order.

    Only irreducible values (the bytes before the two suffixes differ) are searched for, by halving
    on stretch hashes; from any other position the value is one less than at the position before.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = before >= 0
    plain = known & (at > 0) & (before > 0)
    plain[plain] = s[at[plain] - 1] == s[before[plain] - 1]
    # a capped value says nothing about the next position, so these are searched for as well
    head = np.flatnonzero(~plain & known)
    sums = C.prefix_sums(s)

    def measure(i: np.ndarray) -> np.ndarray:
        j, low, high = before[i], np.zeros(len(i), np.int64), np.minimum(cap, n - np.maximum(i, before[i]))
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = C.stretch(sums, i, i + mid) == C.stretch(sums, j, j + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    value = np.zeros(n, np.int64)
    value[head] = measure(head)
    # irreducible heads at the cap may stand for longer ones: extend them without a cap by doubling
    long = head[value[head] >= cap]
    if len(long):
        true = value[long].copy()
        live = np.arange(len(long))
        while len(live):
            i, j = long[live] + true[live], before[long[live]] + true[live]
            room = n - np.maximum(i, j)
            step = np.minimum(cap, room)
            low, high = np.zeros(len(live), np.int64), step
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = C.stretch(sums, i, i + mid) == C.stretch(sums, j, j + mid)
                grow = (low < high) & same
                high = np.where((low < high) & ~same, mid - 1, high)
                low = np.where(grow, mid, low)
            true[live] += low
            live = live[(low == step) & (step > 0)]
        value[long] = true
    source = np.where(plain, -1, at)
    source = np.maximum.accumulate(source)
    out = np.where(plain, value[source] - (at - source), value)
    out[~known] = 0
    return np.minimum(np.maximum(out, 0), cap)


def repeated_starts(s: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions where a ``width``-byte string starts that also starts elsewhere in ``s``."""
    if len(s) < width:
        return np.zeros(len(s), bool)
    sa = suffix_array(s)
    plcp = common_prefixes(s, sa, width)
    hit = plcp >= width
    before = np.full(len(s), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    hit[before[hit & (before >= 0)]] = True
    return hit


# ---------------------------------------------------------------- anchors


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of every ``width`` neighbours: running extremes of blocks from both sides."""
    n = len(x)
    pad = -n % width
    fill = x.dtype.type(np.iinfo(x.dtype).max if pick is np.minimum else 0)
    full = np.r_[x, np.full(pad, fill, x.dtype)].reshape(-1, width)
    front = pick.accumulate(full, axis=1).ravel()
    back = pick.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return pick(back[:m], front[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, width: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor hash, offset of the first and last string it stands for, hash of the covered bytes.

    Every ``width``-byte string is dealt to the last of the smallest ANCHOR-byte hashes inside it, so
    equal strings have equal anchors at equal places, and each string of a text has one anchor.
    """
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(0, U)
    sums = C.prefix_sums(data)
    at = np.arange(n - ANCHOR + 1)
    h = C.stretch(sums, at, at + ANCHOR)
    span = width - ANCHOR + 1
    low = _sliding(h, span, np.minimum)  # smallest hash of the string at each start
    starts = np.arange(len(low))
    # place of the last smallest hash: the smallest hashes of all strings are few, look them up from the right
    is_low = np.zeros(len(h), bool)
    peak = _sliding(np.r_[np.zeros(span - 1, U), low, np.zeros(span - 1, U)], span, np.maximum)
    is_low = h == peak
    spots = np.flatnonzero(is_low)
    spot = np.searchsorted(spots, starts + span - 1, "right") - 1
    while True:
        wrong = h[spots[spot]] != low
        if not wrong.any():
            break
        spot[wrong] -= 1
    p = spots[spot]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    last = np.r_[first[1:], len(p)] - 1
    inside = (p[first] - first).astype(U)
    piece = C.mix(C.stretch(sums, first, last + width) + inside)
    return h[p[first]], first, last, piece


# ---------------------------------------------------------------- Spark


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = C.buffers(batch.column("text"))
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            for a, b in C.pieces(offs):
                parts = [anchors(data[offs[r] : offs[r + 1]], width) for r in range(a, b)]
                count = [len(p[0]) for p in parts]
                g, f, l, x = (np.concatenate([p[i] for p in parts]) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[a:b], count)), pa.array(f), pa.array(l - f + width), pa.array(g.view(np.int64)), pa.array(x.view(np.int64))],
                    ["row", "at", "size", "anchor", "piece"],
                )

    return docs.select("row", "text").mapInArrow(run, "row long, at long, size long, anchor long, piece long")


def _marked(shards: DataFrame, width: int) -> DataFrame:
    """Repeated stretches (byte ranges) of every piece, from one suffix array per shard of pieces."""

    def shard(rows: list[tuple[int, int, int, bytes]]):
        texts = [np.frombuffer(r[3], np.uint8) for r in rows]
        joined = np.concatenate([np.r_[t, np.uint8(_GAP)] for t in texts])
        hit = repeated_starts(joined, width)
        at = 0
        keys, spans = [], []
        for r, t in zip(rows, texts):
            own = hit[at : at + len(t)].copy()
            if r[2] > 1:
                own[: len(t) - width + 1] = True
            own[len(t) - width + 1 :] = False
            at += len(t) + 1
            if own.any():
                edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
                keys.append(r[:2])
                spans.append(np.c_[edge[::2], edge[1::2] - 1 + width].ravel().tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(spans, pa.list_(pa.int64()))],
            ["anchor", "piece", "spans"],
        )

    def run(batches):
        # rows come ordered by anchor and piece; a shard ends at the first new anchor beyond its size
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "copies", "bytes"))):
                if held and row[:2] == held[-1][:2]:
                    # lent once more by an equal row, and counted in copies already
                    continue
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield shard(held)

    return shards.mapInArrow(run, "anchor long, piece long, spans array<long>")


def _crowded_marks(texts: DataFrame, width: int) -> DataFrame:
    """Repeated stretches of the pieces of crowded anchors, string by string.

    An anchor inside a passage that very many texts share has more pieces than one task should
    hold. Its strings are counted by hash with map-side combine instead, on all executors.
    """

    def run(batches):
        for batch in batches:
            for anchor, piece, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "copies", "bytes"))):
                text = np.frombuffer(raw, np.uint8)
                at = np.arange(len(text) - width + 1)
                h = C.stretch(C.prefix_sums(text), at, at + width)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, piece)), pa.array(np.full(n, copies)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))],
                    ["anchor", "piece", "copies", "at", "h"],
                )

    strings = texts.mapInArrow(run, "anchor long, piece long, copies long, at int, h long")
    twice = strings.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    hits = strings.join(twice, "h").groupBy("anchor", "piece").agg(F.collect_list(F.col("at").cast("long")).alias("starts"))
    return hits.select("anchor", "piece", F.flatten(F.transform("starts", lambda x: F.array(x, x + width))).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = MIN_BYTES, whole: bool = False) -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts anywhere else.

    In: doc_id, text (NULL: empty); other columns are ignored. Texts are UTF-8 bytes, matches never
    cross documents, a string may repeat in the same document and may overlap itself, and strings
    are judged on the input. Out: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``whole`` also kept (the remaining bytes). Equal texts of ``width`` bytes or
    more are removed whole; an empty table gives no rows. Rows are told apart by doc_id and text, so
    doc_id may be NULL or repeat; equal rows count as repeats of each other. ``removed`` says
    whether anything was removed. A long text is one row of any length.

    Every string belongs to one anchor (the last smallest hash inside it), so only the strings of
    an anchor must be compared. Stretches of equal strings with equal anchors collapse to one piece
    with a count. Pieces of an anchor that spells more than one piece go to shards; each shard is
    sorted by induced sorting and read off its permuted common prefixes. Strings of an anchor with
    more than CROWDED pieces are counted one by one instead.
    """
    base = docs.select(C.row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = C.stored(_occurrences(base, width), "anchors")
    pieces = found.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at", "size")).alias("first"))
    pieces = C.stored(pieces, "pieces")
    groups = pieces.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).where("total > 1")
    several = pieces.join(groups.where("kinds > 1").select("anchor", "kinds"), "anchor")
    # one row per document that lends its text to pieces: the places it lends
    lent = several.groupBy(F.col("first.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "piece", "copies", F.col("first.at").alias("at"), F.col("first.size").alias("size"), "kinds")).alias("places")
    )
    cut = base.select("row", F.col("text").cast("binary").alias("raw")).join(lent, "row").select("raw", F.explode("places").alias("p"))
    texts = cut.select("p.anchor", "p.piece", "p.copies", "p.kinds", F.substring("raw", F.col("p.at").cast("int") + 1, F.col("p.size").cast("int")).alias("bytes"))
    texts = C.stored(texts, "pieces")
    shards = texts.where(F.col("kinds") <= CROWDED).repartition("anchor").sortWithinPartitions("anchor", "piece")
    partly = _marked(shards, width).union(_crowded_marks(texts.where(F.col("kinds") > CROWDED).dropDuplicates(["anchor", "piece"]), width))
    wholly = pieces.where("copies > 1").join(groups.where("kinds = 1").select("anchor"), "anchor").select(
        "anchor", "piece", F.array(F.lit(0), F.col("first.size")).cast("array<bigint>").alias("spans")
    )
    marks = C.stored(partly.union(wholly), "marks")
    runs = (
        found.join(marks, ["anchor", "piece"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("at", "spans"))).alias("runs"))
    )
    extra = ", kept binary" if whole else ""

    def run(batches):
        for batch in batches:
            data, offs = C.buffers(batch.column("text"))
            out = []
            for text, runs in zip((data[a:b] for a, b in zip(offs[:-1], offs[1:])), batch.column("runs").to_pylist()):
                step = np.zeros(len(text) + 1, np.int32)
                for r in runs or ():
                    span = np.array(r["spans"]) + r["at"]
                    np.add.at(step, span[::2], 1)
                    np.add.at(step, span[1::2], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = text[~gone].tobytes() if len(text) else b""
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(text) else 0
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, sha, kept = zip(*out) if out else ((),) * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in removed], pa.bool_())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            if whole:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = base.join(runs, "row", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed boolean" + extra)
