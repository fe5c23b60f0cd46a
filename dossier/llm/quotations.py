"""Quotation linking: messages joined to the originals they quote, in reply order and without quotes."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_MARK = re.compile(r"(?:[ \t]*>)+")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text of a message, and its quoted passages: runs of lines of one level (the number of marks)."""
    own, passages = [], []
    for line in text.split("\n"):
        m = _MARK.match(line)
        level = m[0].count(">") if m else 0
        body = line[m.end() :].removeprefix(" ") if m else line
        if level == 0:
            own.append(body)
            passages.append((0, ""))
        elif passages and passages[-1][0] == level:
            passages[-1] = (level, passages[-1][1] + "\n" + body)
        else:
            passages.append((level, body))
    return "\n".join(own).strip("\n"), [p for p in passages if p[0]]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _key(text: str) -> str | None:
    plain = normal(text)
    return hashlib.blake2b(plain.encode(), digest_size=16).hexdigest() if plain else None


def _parsed(messages: DataFrame) -> DataFrame:
    """Per message its own text and the keys that others may quote or that it quotes.

    own: key of the whole own text, lines: keys of its lines; quotes: level, key, weight of every
    quoted passage (weight 2) and of each of its lines (weight 1).
    """
    schema = "conv_id long, turn long, body string, own string, lines array<string>, quotes array<struct<level:int,key:string,weight:int>>"
    quote = pa.struct([("level", pa.int32()), ("key", pa.string()), ("weight", pa.int32())])

    def run(batches):
        for batch in batches:
            body, own, lines, quotes = [], [], [], []
            for text in batch.column("text").to_pylist():
                mine, passages = parse(text or "")
                body.append(mine)
                own.append(_key(mine))
                lines.append(sorted({k for k in map(_key, mine.split("\n")) if k}))
                found = {(lv, k, 2) for lv, p in passages if (k := _key(p))}
                found |= {(lv, k, 1) for lv, p in passages for x in p.split("\n") if (k := _key(x))}
                quotes.append([{"level": a, "key": b, "weight": c} for a, b, c in sorted(found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(body, pa.string()), pa.array(own, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(quotes, pa.list_(quote))],
                ["conv_id", "turn", "body", "own", "lines", "quotes"],
            )

    return messages.select("conv_id", "turn", "text").mapInArrow(run, schema)


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with its reply target, place in the reply order, and text without quotes.

    In: conv_id, turn, text; rows without conv_id or turn are left out, of repeated (conv_id, turn)
    the smallest text counts, other columns are ignored. A quoted passage is joined by the hash of
    its normalised text to the first earlier message of the conversation whose own text (or, as
    weaker evidence, a line of it) is the same. reply_to is the target of the shallowest level with
    the strongest evidence (ties: the latest message); NULL if nothing quoted was written before.
    Out: conv_id, turn, reply_to, root (first message of the reply chain), depth, n_quotes (quoted
    passages), n_linked (those found), body. Reading order of a conversation: root, depth, turn.
    """
    clean = (
        messages.where("conv_id is not null and turn is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
        .agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    )
    parsed = C.stored(_parsed(clean), "messages")
    whole = parsed.where("own is not null").select("conv_id", "turn", F.col("own").alias("key"), F.lit(2).alias("weight"))
    line = parsed.select("conv_id", "turn", F.explode("lines").alias("key"), F.lit(1).alias("weight"))
    # one row per key: the join below never multiplies rows
    first = whole.union(line).groupBy("conv_id", "key", "weight").agg(F.min("turn").alias("target"))
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    linked = quotes.join(first, ["conv_id", "key", "weight"], "left").withColumn("target", F.when(F.col("target") < F.col("turn"), F.col("target")))
    votes = (
        linked.where("target is not null").groupBy("conv_id", "turn", "level", "target").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "w", "n", "target")).alias("best"))
    )
    counts = linked.where("weight = 2").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("target").alias("n_linked"))
    replies = C.stored(
        parsed.select("conv_id", "turn", "body").join(votes.select("conv_id", "turn", F.col("best.target").alias("reply_to")), ["conv_id", "turn"], "left")
        .join(counts, ["conv_id", "turn"], "left"),
        "replies",
    )
    # chains of any length in as many passes as the logarithm of the longest
    jump = C.stored(
        replies.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("root"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth")), "jumps"
    )
    while True:
        up = jump.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        new = C.stored(
            jump.join(up, ["conv_id", "root"]).select("conv_id", "turn", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")),
            "jumps",
        )
        done = new.where("moved").isEmpty()
        jump = new.drop("moved")
        if done:
            break
    return replies.join(jump, ["conv_id", "turn"]).select(
        "conv_id", "turn", "reply_to", "root", "depth", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "body"
    )


def quoted_mail(talk: DataFrame) -> DataFrame:
    """``conversations`` as mail: every turn quotes the turn before it, which quotes the one before that."""
    turns = talk.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    for step in (1, 2):
        back = turns.select("conv_id", (F.col("turn") + step).alias("turn"), F.col("text").alias(f"back{step}"))
        turns = turns.join(back, ["conv_id", "turn"], "left")

    def marked(text, mark: str):
        return F.concat(F.lit("\n" + mark), F.regexp_replace(text, "\n", "\n" + mark))

    return turns.select(
        "conv_id", "turn",
        F.concat("text", F.coalesce(marked(F.col("back1"), "> "), F.lit("")), F.coalesce(marked(F.col("back2"), "> > "), F.lit(""))).alias("text"),
    )
