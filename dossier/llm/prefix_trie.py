"""Prefix trie of conversations: sorted matrices of turn ids, one shard each, joined at the shard borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Turns of a shard, held by one task at about 60 bytes each, and the columns of one matrix.
SHARD = 1_000_000
SMALL_SHARD = 20_000
BAND = 16
#: Conversation ids hashed as one piece where a node's ends lie in several shards.
CHUNK = 8_192
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "kind int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, shard int, side int, cum long, own long, length long, ends string"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_lists(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """Turns of every conversation in order: conv_id, grp, turns(id, n).

    ``id`` is the first half of the SHA-256 of role and text, ``n`` the text's UTF-8 bytes. NULL
    turns come first, rows of one turn are ordered by id, NULL role and text are empty; rows
    without conv_id belong to no conversation. Texts are left behind here: what follows handles
    about 20 bytes a turn. A conversation's list is one row. ``group`` names rows to be kept together.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull()).select(
        c.alias("conv_id"), (c if group is None else group).alias("grp"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("id"), F.octet_length(text).alias("n")
        ).alias("t"),
    )
    # dealt by grp, which also serves the grouping by (grp, conv_id)
    lists = rows.repartition("grp").groupBy("grp", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", "grp", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["n"].alias("n"))).alias("turns"))


def branched(conversations: DataFrame, siblings: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share their start: conv_id, turns.

    Conversation c takes its first h turns (all if fewer, none if absent) from conversation
    c - c % siblings and the rest from its own; h is crc32(c as text) % ``most``.
    """
    c = F.col("conv_id").cast("long")
    lists = turn_lists(conversations, c - c % siblings)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    mine = Window.partitionBy("grp")
    head = F.max(F.when(F.col("conv_id") == F.col("grp"), F.slice("turns", 1, most - 1))).over(mine)
    whole = lists.withColumn("head", head).withColumn("h", h)
    start = F.when(F.col("h") > 0, F.expr("slice(head, 1, h)"))
    rest = F.expr("slice(turns, h + 1, size(turns))")
    return whole.select("conv_id", F.when(start.isNull(), rest).otherwise(F.concat(start, rest)).alias("turns"))


def sorted_rows(conv: np.ndarray, offs: np.ndarray, turn: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their turn ids, then conv, and how many turns each shares with the one before (first: -1).

    Matrices of ``band`` columns, padded with 0: lexsort orders the rows, and the mask of changed
    columns, OR-ed along each row, ends where two rows part. Only rows that reach a band are in its matrix.
    """
    length = np.diff(offs)
    order = np.argsort(conv, kind="stable")
    group = np.zeros(len(conv), np.int64)
    shared = np.zeros(len(conv), np.int64)
    columns = np.arange(band)
    base = 0
    while True:
        at = np.flatnonzero(length[order] >= base)
        rows = order[at]
        inside = base + columns < length[rows][:, None]
        matrix = np.zeros((len(rows), band), np.int32)
        matrix[inside] = turn[(offs[rows][:, None] + base + columns)[inside]]
        by = np.lexsort((conv[rows], *matrix.T[::-1], group[at]))
        order[at], matrix, g = rows[by], matrix[by], group[at]
        change = matrix[1:] != matrix[:-1]
        apart = g[1:] != g[:-1]
        mask = np.logical_or.accumulate(change, axis=1)
        together = np.flatnonzero(~apart)
        shared[at[1:][together]] = base + band - mask[together].sum(axis=1)
        group[at] = np.cumsum(np.r_[0, apart | mask[:, -1]])
        base += band
        if not (length > base).any():
            break
    shared = np.minimum(shared, length[order])
    shared[:1] = -1
    return order, shared


def prefix_hashes(ids: np.ndarray) -> list[bytes]:
    """A name for every prefix of a path, the empty one first; ``ids`` has 16 bytes a turn."""
    running, out = hashlib.sha256(), []
    out.append(running.digest()[:16])
    for x in ids:
        running.update(x.tobytes())
        out.append(running.copy().digest()[:16])
    return out


def shard_nodes(conv: np.ndarray, offs: np.ndarray, ids: np.ndarray, size: np.ndarray, shard: int = 0) -> Iterator[dict]:
    """Nodes of one shard's conversations, a dict of columns per depth, and pieces of ends.

    A node's members are consecutive rows, and each figure is a sum over them: with the turns a
    row shares with the row before, a row knows the nodes that start with it. Nodes on the path of
    the first or the last row may go on in another shard (kind 1, ends as kind 2); all others are whole (kind 0).
    """
    halves = ids.view(">u8").astype(np.uint64).reshape(-1, 2)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    turn = np.zeros(len(ids), np.int32)
    if len(ids):
        turn[by] = 1 + np.cumsum(np.r_[False, (halves[by][1:] != halves[by][:-1]).any(axis=1)])
    order, shared = sorted_rows(conv, offs, turn)
    length, conv = np.diff(offs)[order], conv[order]
    begin = offs[:-1][order]
    sums = np.r_[0, np.cumsum(size)]

    def cum(rows, depth):
        return sums[begin[rows] + depth] - sums[begin[rows]]

    every = np.arange(len(conv))
    total = cum(every, length)
    started = total - cum(every, np.maximum(shared, 0))
    leaf = np.r_[shared[1:] < length[:-1], True].astype(np.int64)
    paths = [prefix_hashes(ids[begin[r] : begin[r] + length[r]]) for r in (0, -1)]
    border = np.zeros(len(conv), np.int8)  # path (1 first, 2 last) of the node one turn up that a row belongs to
    above = np.zeros(len(conv), np.int64)  # its smallest member
    alive = every
    for depth in range(int(length.max()) + 1):
        alive = alive[length[alive] >= depth]
        at = np.flatnonzero(shared[alive] < depth)
        first = alive[at]
        n = np.diff(np.r_[at, len(alive)])
        smallest = np.minimum.reduceat(conv[alive], at)
        before = cum(first, depth - 1) if depth else np.zeros(len(at), np.int64)
        begun = started[alive]
        begun[at] = total[first] - before
        side = np.zeros(len(at), np.int8)
        if alive[0] == 0:
            side[0] |= 1
        if alive[-1] == len(conv) - 1:
            side[-1] |= 2
        up = border[first]
        ending = np.add.reduceat((length[alive] == depth).astype(np.int64), at)
        hashed, names, parents = [EMPTY] * len(at), [None] * len(at), [None] * len(at)
        for k in np.flatnonzero(ending).tolist():
            own = conv[alive[at[k]] : alive[at[k]] + ending[k]].tolist()
            if not side[k]:
                hashed[k] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
                continue
            pieces = [",".join(map(str, own[i : i + CHUNK])) for i in range(0, len(own), CHUNK)]
            name = paths[0 if side[k] & 1 else 1][depth]
            yield {"kind": [2] * len(pieces), "node": [name] * len(pieces), "shard": [shard] * len(pieces), "cum": list(range(len(pieces))), "ends": pieces}
        for k in np.flatnonzero(side).tolist():
            names[k] = paths[0 if side[k] & 1 else 1][depth]
        for k in np.flatnonzero(up).tolist():
            parents[k] = paths[up[k] - 1][depth - 1]
        yield {
            "kind": (side > 0).astype(np.int32), "node": names, "parent": parents, "depth": np.full(len(at), depth), "conv_id": smallest,
            "parent_conv_id": pa.array(above[first], pa.int64(), mask=np.full(len(at), depth == 0) | (up > 0)),
            "n_convs": n, "n_children": np.add.reduceat(((shared[alive] <= depth) & (length[alive] > depth)).astype(np.int64), at),
            "n_leaves": np.add.reduceat(leaf[alive], at),
            "saved_tokens": np.add.reduceat(total[alive] - begun, at) - n * before,
            "ends_sha256": hashed, "shard": np.full(len(at), shard, np.int32), "side": side.astype(np.int32),
            "cum": cum(first, depth), "own": cum(first, depth) - before, "length": np.full(len(at), length[-1]),
        }
        border[alive] = np.repeat(np.where(side & 1, 1, np.where(side & 2, 2, 0)).astype(np.int8), n)
        above[alive] = np.repeat(smallest, n)


def _batches(parts: Iterator[dict], schema: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns of many depths as few batches; columns a part lacks are NULL."""
    held, count = [], 0

    def flushed():
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for part in parts:
        n = len(part["kind"])
        columns = [pa.nulls(n, f.type) if part.get(f.name) is None else pa.array(part[f.name]).cast(f.type) for f in schema]
        held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        count += n
        if count >= rows:
            yield from flushed()
            held, count = [], 0
    if held:
        yield from flushed()


def _ends(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node of several shards: node, sha. Pieces are streamed in order."""

    def run(batches):
        node = running = None
        for batch in batches:
            done: list[tuple] = []
            for name, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, running.hexdigest()))
                    node, running = name, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "sha"])

    ordered = pieces.repartition("node").sortWithinPartitions("node", "shard", "cum").select("node", "ends")
    return ordered.mapInArrow(run, "node binary, sha string")


def trie(lists: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """Every distinct prefix of the turn lists ``lists(conv_id, turns)`` as a node.

    Out: conv_id (smallest member), depth, parent_conv_id (the parent's; root: NULL), n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, members
    less one times the bytes of the last text), ends_sha256 (of the ids of members that end here).
    conv_id must not repeat. An empty list is a member of the root alone; an empty table has no nodes.

    Lists are dealt to ranges of (turns, conv_id), so equal conversations, however many, spread
    over shards. A shard's nodes are whole but for those on its two outer paths; these are added
    up by prefix, less what two neighbours both counted.
    """
    lists = C.stored(lists.select("conv_id", "turns"), "trie-turns")
    turns = lists.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    if shard_turns:
        shards = -(-turns // shard_turns)
    else:
        parallel = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(-(-turns // SHARD), min(parallel, -(-turns // SMALL_SHARD)))

    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in NODES.split(", "))])

    def run(batches):
        conv, sizes, ids, bytes_ = [], [], [], []
        for batch in batches:
            t = batch.column("turns")
            inner = t.flatten()
            conv.append(np.asarray(batch.column("conv_id")))
            sizes.append(np.diff(np.asarray(t.offsets)))
            ids.append(np.frombuffer(b"".join(inner.field("id").to_pylist()), np.uint8).reshape(-1, 16))
            bytes_.append(np.asarray(inner.field("n")).astype(np.int64))
        if sum(map(len, conv)) == 0:
            return
        offs = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)
        yield from _batches(shard_nodes(np.concatenate(conv), offs, np.concatenate(ids), np.concatenate(bytes_), TaskContext.get().partitionId()), schema)

    parts = C.stored(lists.repartitionByRange(max(1, int(shards)), "turns", "conv_id").mapInArrow(run, NODES), "trie-parts")
    outer = parts.where("kind = 1")
    firsts, lasts = outer.where("side in (1, 3)"), outer.where("side in (2, 3)")
    # one row per shard: the next shard that holds rows, and how far its first path agrees with this one's last
    following = outer.where("depth = 0").select(F.col("shard").alias("left"), F.lead("shard").over(Window.orderBy("shard")).alias("right"))
    left = lasts.join(following, F.col("shard") == F.col("left")).select("left", "right", "node", "length")
    right = firsts.select(F.col("shard").alias("right"), "node", "depth", "cum")
    meets = C.stored(
        left.join(right, ["right", "node"]).groupBy("left", "right").agg(F.max("depth").alias("same"), F.max("cum").alias("same_cum"), F.max("length").alias("last")),
        "trie-meets",
    )
    zero = F.lit(0).cast("long")
    twice = firsts.join(meets, F.col("shard") == F.col("right")).where("depth <= same").select(
        "node", "parent", "depth", "conv_id", zero.alias("n_convs"), F.when(F.col("depth") < F.col("same"), F.lit(-1)).otherwise(0).cast("long").alias("n_children"),
        zero.alias("n_leaves"), (F.col("same_cum") - F.col("cum") + F.col("own")).alias("saved_tokens"),
    )
    not_leaf = lasts.join(meets, F.col("shard") == F.col("left")).where("same >= last").select(
        "node", "parent", "depth", "conv_id", zero.alias("n_convs"), zero.alias("n_children"), F.lit(-1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
    )
    added = outer.select("node", "parent", "depth", "conv_id", *SUMS).union(twice).union(not_leaf).groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS)
    )
    whole = C.stored(added.join(_ends(parts.where("kind = 2")), "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha"), "trie-outer")
    parents = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("known"))
    inner = parts.where("kind = 0").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("known", "parent_conv_id"))
    return inner.select(*OUT).union(whole.join(parents, "parent", "left").withColumnRenamed("known", "parent_conv_id").select(*OUT))


def conversation_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """Trie of the branched conversations; see ``turn_lists``, ``branched`` and ``trie`` for the rules.

    In: conv_id, turn, role, text; other columns are ignored. NULL role or text is empty, NULL
    turns come first, rows without conv_id are left out; an empty table gives no rows.
    """
    return trie(branched(conversations), shard_turns)


def conversation_trie_sql(siblings: int = 5, most: int = 9) -> str:
    """The same nodes by grouping every prefix of every conversation, as SQL."""
    return f"""
WITH RECURSIVE steps(b, n, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, n + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE n = 8),
lists AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT c, l, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295::BIGINT) % {most} AS h FROM lists, crc),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(s.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM heads a LEFT JOIN lists s ON s.c = a.c - a.c % {siblings}),
prefixes AS (SELECT c, len(l) AS n, d, l[1:d] AS p, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS b FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM prefixes GROUP BY p, d),
above AS (SELECT x.conv_id, x.d, u.conv_id AS u, u.d AS ud, x.n_convs, x.b FROM nodes x JOIN prefixes y ON y.c = x.conv_id AND y.d <= x.d JOIN nodes u ON u.d = y.d AND u.p = y.p),
kids AS (SELECT u, ud, count(*) AS n FROM above WHERE ud = d - 1 GROUP BY u, ud),
below AS (
  SELECT a.u, a.ud, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.b)::BIGINT AS saved
  FROM above a LEFT JOIN kids k ON k.u = a.conv_id AND k.ud = a.d GROUP BY a.u, a.ud)
SELECT x.conv_id, x.d AS depth, a.u AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below b ON b.u = x.conv_id AND b.ud = x.d
LEFT JOIN kids k ON k.u = x.conv_id AND k.ud = x.d
LEFT JOIN above a ON a.conv_id = x.conv_id AND a.d = x.d AND a.ud = x.d - 1"""
