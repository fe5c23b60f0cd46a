"""Security master: upsert, industry snapshot and history, name dictionary, index bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.fields import exchange_of, valid_code
from ..functions.text import normalize_name

INDUSTRY_FIELDS = ["l1_code", "l1_name", "l2_code", "l2_name", "l3_code", "l3_name", "effective_date"]


def latest_industry(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Industry per code at the highest (effective date, update time), a missing update time lowest.

    Industry codes outside the code table keep their prefixes as level codes, without names.
    """
    no_time = F.lit("0001-01-01").cast("timestamp")
    order = F.struct(
        "effective_date", F.coalesce("source_updated_at", no_time), "industry_code"
    )
    latest = (
        rows.where(valid_code(F.col("code")))
        .groupBy("code")
        .agg(F.max_by(F.struct("industry_code", "effective_date"), order).alias("r"))
        .select("code", F.col("r.industry_code").alias("l3_code"), "r.effective_date")
    )
    prefix = lambda n: F.left(F.col("l3_code"), F.lit(n))
    return latest.join(names, "l3_code", "left").select(
        "code",
        F.coalesce("l1_code", prefix(2)).alias("l1_code"),
        "l1_name",
        F.coalesce("l2_code", prefix(4)).alias("l2_code"),
        "l2_name",
        "l3_code",
        "l3_name",
        "effective_date",
    )


def upsert_master(existing: DataFrame, stocks: DataFrame, industry: DataFrame) -> DataFrame:
    """New master snapshot by code.

    A listed stock overwrites name, key and exchange; codes known only from industry history are
    delisted and get an empty name; the newest industry replaces the stored one as a whole.
    """
    listed = stocks.where(valid_code(F.col("code"))).select(
        "code",
        F.struct(
            F.col("name"),
            normalize_name(F.col("name")).alias("name_norm"),
            exchange_of(F.col("code")).alias("exchange"),
        ).alias("_stock"),
    )
    classified = industry.select("code", F.struct(*INDUSTRY_FIELDS).alias("_industry"))
    stored = existing.select(
        "code",
        F.struct("name", "name_norm", "exchange").alias("_name"),
        F.struct(*INDUSTRY_FIELDS).alias("_old_industry"),
        "historical_names",
    )
    joined = stored.join(listed, "code", "full_outer").join(classified, "code", "full_outer")
    naming = F.coalesce("_stock", "_name")
    label = lambda field: F.coalesce(naming[field], F.lit("")).alias(field)
    field = F.coalesce("_industry", "_old_industry")
    return joined.select(
        "code",
        label("name"),
        label("name_norm"),
        label("exchange"),
        *[field[c].alias(c) for c in INDUSTRY_FIELDS],
        F.coalesce("historical_names", F.array().cast("array<string>")).alias("historical_names"),
    )


HISTORY_KEY = ["code", "effective_date", "industry_code"]


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to insert: valid codes, each (code, date, industry) once and not stored yet."""
    return (
        rows.where(valid_code(F.col("code")))
        .groupBy(*HISTORY_KEY)
        .agg(F.min("source_updated_at").alias("source_updated_at"))
        .join(history, HISTORY_KEY, "left_anti")
    )


def union_historical_names(stored: Column, incoming: Column, current: Column) -> Column:
    """Stored names first, then the new ones in order; no blanks, not the current name."""
    none = F.array().cast("array<string>")
    kept = F.coalesce(stored, none)
    new = F.filter(
        F.array_distinct(F.coalesce(incoming, none)),
        lambda n: (n != "") & (n != current) & ~F.array_contains(kept, n),
    )
    return F.concat(kept, new)


def name_dictionary(master: DataFrame) -> DataFrame:
    """(key, code) rows over current and historical names; a key may lead to several codes."""
    former = master.select("code", F.explode("historical_names").alias("name")).select(
        normalize_name(F.col("name")).alias("key"), "code"
    )
    current = master.select(F.col("name_norm").alias("key"), "code")
    return current.unionByName(former).where("key <> ''").distinct()


def bridge_vote(constituents: DataFrame, classification: DataFrame, prefix_chars: int) -> DataFrame:
    """Index -> classification code its constituents vote for with at least 60 %.

    Votes are counted per (index, prefix) first, so an index with a third of all constituents
    only brings its few prefixes to the second step. Equal votes go to the smallest prefix.
    """
    votes = (
        constituents.join(classification, "code")
        .groupBy("index_code", F.left("industry_code", F.lit(prefix_chars)).alias("prefix"))
        .agg(F.count("*").alias("n"))
    )
    tally = votes.groupBy("index_code").agg(
        F.sum("n").alias("votes"),
        F.max("n").alias("top"),
        F.min(F.struct((-F.col("n")).alias("votes"), "prefix"))["prefix"].alias("winner"),
    )
    all_indexes = constituents.select("index_code").distinct()
    share = F.col("top") / F.col("votes")
    return all_indexes.join(tally, "index_code", "left").select(
        "index_code",
        F.when(share >= K.BRIDGE_SHARE, F.col("winner")).alias("industry_code"),
        F.when(F.col("votes").isNull(), "no_overlap")
        .when(share < K.BRIDGE_SHARE, "ambiguous")
        .alias("failure"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
    )
