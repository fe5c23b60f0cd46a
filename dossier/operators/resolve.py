"""Company resolution: code stage, exact names, fuzzy names, review queue.

Names are resolved once per distinct key and joined back to the mentions.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import constants as K
from ..session import cut_lineage


@F.pandas_udf(DoubleType())
def _ratio(names: pd.Series, keys: pd.Series) -> pd.Series:
    """difflib ratio; the order of the arguments matters."""
    matcher = SequenceMatcher()
    out, last = [], None
    # the matcher indexes its second text, so equal neighbours are indexed once
    for name, key in zip(names, keys):
        if key != last:
            matcher.set_seq2(key)
            last = key
        matcher.set_seq1(name)
        out.append(matcher.ratio())
    return pd.Series(out)


# marked so that a filter on the score does not score every pair a second time
similarity = _ratio.asNondeterministic()


def _signature(names: DataFrame, side: str) -> DataFrame:
    """Numbered characters per name ('a', second 'a', ...): set overlap = multiset overlap."""
    chars = F.split(F.col("key"), "")
    numbered = F.transform(
        chars,
        lambda c, i: F.concat(
            c,
            F.lit("#"),
            F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string"),
        ),
    )
    return names.select(
        F.col("key").alias(side), F.length("key").alias(f"{side}_len"), F.explode(numbered).alias("token")
    )


def _least_overlap(length: Column, threshold: float) -> Column:
    return F.ceil(length * (threshold / (2 - threshold)) - 1e-9).cast("int")


def similar_pairs(
    names: DataFrame, dictionary: DataFrame, threshold: float, scored: Observation | None = None
) -> DataFrame:
    """All (name, entry, score) with score >= threshold, over distinct keys; nothing is missed.

    ``scored`` observes how many pairs were compared letter by letter (pairs).

    ratio = 2M / (|a|+|b|) and M never exceeds the number of shared characters, so a pair at or
    above the threshold has similar lengths and shares a character among the rarest few of both
    (prefix filter). The join key also carries the length of the entry: only lengths that can
    qualify meet, and a frequent character is spread over many keys.
    """
    left, right = _signature(names, "name"), _signature(dictionary, "entry")
    # one row per character of the alphabet and repetition: small, however many names there are
    rarity = (
        left.select("token")
        .unionByName(right.select("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .select("token", F.row_number().over(W.orderBy("n", "token")).alias("rank"))
    )

    def ranked(rows: DataFrame, side: str) -> DataFrame:
        # regrouped per name: as many rows as the name has characters
        keep = F.col(f"{side}_len") - _least_overlap(F.col(f"{side}_len"), threshold) + 1
        return (
            rows.join(rarity, "token")
            .groupBy(side, f"{side}_len")
            .agg(F.array_sort(F.collect_list("rank")).alias(f"{side}_chars"))
            .withColumn(f"{side}_prefix", F.slice(f"{side}_chars", F.lit(1), F.greatest(keep, F.lit(1))))
        )

    shortest = _least_overlap(F.col("name_len"), threshold)
    longest = F.floor(F.col("name_len") * ((2 - threshold) / threshold) + 1e-9).cast("int")
    a = (
        ranked(left, "name")
        .withColumn("entry_len", F.explode(F.sequence(F.greatest(shortest, F.lit(1)), longest)))
        .withColumn("rank", F.explode("name_prefix"))
    )
    b = ranked(right, "entry").withColumn("rank", F.explode("entry_prefix"))
    enough = F.ceil((F.col("name_len") + F.col("entry_len")) * (threshold / 2) - 1e-9)
    met = a.join(b, ["rank", "entry_len"]).where(
        (F.size(F.array_intersect("name_chars", "entry_chars")) >= enough)
        # each pair is taken at its rarest common character only, so no distinct is needed
        & (F.array_min(F.array_intersect("name_prefix", "entry_prefix")) == F.col("rank"))
    )
    # scoring is CPU work on few bytes: spread the pairs evenly instead of by size, and keep
    # equal entries together, since the matcher indexes its second text
    slots = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (
        met.select("name", "entry").repartition(slots, "name", "entry").sortWithinPartitions("entry")
    )
    if scored is not None:
        spread = spread.observe(scored, F.count(F.lit(1)).alias("pairs"))
    return spread.select(
        "name", "entry", similarity(F.col("name"), F.col("entry")).alias("score")
    ).where(F.col("score") >= threshold)


def exact_stage(names: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, candidates) of names that stand in the dictionary.

    verdict: one code -> resolved; several -> multi_candidate with all of them at score 1.0.
    """
    entries = dictionary.groupBy("key").agg(
        F.count("*").alias("n_codes"), F.min("code").alias("code")
    )
    verdicts = names.join(entries, "key").select(
        "key",
        F.when(F.col("n_codes") == 1, F.col("code")).alias("code"),
        F.when(F.col("n_codes") > 1, "multi_candidate").alias("reason"),
    )
    several = verdicts.where("reason IS NOT NULL").select("key")
    candidates = dictionary.join(several, "key").withColumn("score", F.lit(1.0))
    return verdicts, candidates


def fuzzy_stage(
    names: DataFrame,
    dictionary: DataFrame,
    hints: int | None,
    work: list[dict] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, candidates) of names without an exact entry.

    The score of a code is its best over all its names. One code at 0.85 or more -> resolved,
    several -> multi_candidate; none -> no_hit with the nearest ``hints`` codes above 0.5 (None:
    all of them). The search for hints is best first: at thresholds that fall from 0.75 to 0.5 a
    name leaves once it has its hints, as whatever is left scores lower. ``work`` receives a row
    per threshold: names asked and pairs scored.
    """
    names, dictionary = cut_lineage(names, "names"), cut_lineage(dictionary, "name-dictionary")
    keys = cut_lineage(dictionary.select("key").distinct(), "name-keys")
    codes = dictionary.withColumnRenamed("key", "entry")

    def best(left: DataFrame, threshold: float, entries: DataFrame, of: str) -> DataFrame:
        """Best score per name and per code or set (``of``) of the entries."""
        seen = Observation()
        pairs = similar_pairs(left, keys, threshold, seen).join(entries, "entry")
        hits = pairs.groupBy(F.col("name").alias("key"), of).agg(F.max("score").alias("score"))
        hits = cut_lineage(hits, "fuzzy-hits")
        if work is not None:
            work.append({"threshold": threshold, "names": left.count(), "pairs": seen.get["pairs"]})
        return hits

    # codes of equal names score alike: names meet the sets of names, and a set is spelled out as
    # its codes only where they are listed
    owners = dictionary.groupBy("code").agg(F.array_sort(F.collect_set("key")).alias("owned"))
    owners = cut_lineage(owners, "code-names")
    sets = owners.groupBy("owned").agg(F.count("*").alias("n"), F.min("code").alias("code"))
    sets = cut_lineage(sets, "name-sets")
    high = best(names, K.FUZZY_RATIO, sets.select("owned", F.explode("owned").alias("entry")), "owned")
    per_name = high.join(sets, "owned").groupBy("key").agg(F.sum("n").alias("n"), F.min("code").alias("code"))
    per_name = cut_lineage(per_name, "fuzzy-names")
    found = per_name.select(
        "key",
        F.when(F.col("n") == 1, F.col("code")).alias("code"),
        F.when(F.col("n") > 1, "multi_candidate").alias("reason"),
    )
    many = high.join(found.where("reason IS NOT NULL").select("key"), "key", "left_semi")
    several = owners.join(many, "owned").select("key", "code", "score")

    missed = cut_lineage(names.join(per_name, "key", "left_anti"), "names-missed")
    listed, left = several, missed
    if hints is None:
        entries, bands = codes, [K.NEAR_RATIO]
    else:
        # as many codes per entry are enough: a further one cannot be among the nearest
        in_entry = W.partitionBy("entry").orderBy("code")
        entries = codes.withColumn("r", F.row_number().over(in_entry)).where(F.col("r") <= hints).drop("r")
        bands = K.NEAR_BANDS
    nearest = W.partitionBy("key").orderBy(F.desc("score"), "code")
    for threshold in bands:
        near = best(left, threshold, entries, "code")
        if threshold == bands[-1]:
            near = near.where(F.col("score") > K.NEAR_RATIO)
        else:
            settled = near.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hints).select("key")
            near = near.join(settled, "key", "left_semi")
            left = cut_lineage(left.join(settled, "key", "left_anti"), "names-missed")
        if hints is not None:
            near = near.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= hints).drop("r")
        listed = listed.unionByName(near)
    no_hit = missed.select(
        "key", F.lit(None).cast("string").alias("code"), F.lit("no_hit").alias("reason")
    )
    return found.unionByName(no_hit), listed.withColumn("score", F.round("score", 3))


def resolve_names(
    names: DataFrame, dictionary: DataFrame, hints: int | None, work: list[dict] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact stage, then the fuzzy stage for what is left; an empty key is a no_hit.

    ``hints`` and ``work`` as in ``fuzzy_stage``.
    """
    filled = names.where("key <> ''").distinct()
    exact, exact_candidates = exact_stage(filled, dictionary)
    rest = filled.join(exact, "key", "left_anti")
    fuzzy, fuzzy_candidates = fuzzy_stage(rest, dictionary, hints, work)
    empty = names.where("key = ''").distinct().select(
        "key", F.lit(None).cast("string").alias("code"), F.lit("no_hit").alias("reason")
    )
    return exact.unionByName(fuzzy).unionByName(empty), exact_candidates.unionByName(fuzzy_candidates)


def route_mentions(
    mentions: DataFrame, verdicts: DataFrame, codes: DataFrame
) -> DataFrame:
    """Final verdict per mention (key, raw_code, raw_source): target_code, code_source or reason.

    A code that stands in the text and in the master is taken. A code the extractor inferred, or
    one without a source, always goes to review, whatever the name says. A code of the text that
    the master does not know goes to review. Without a code the name decides.
    """
    known = codes.select(F.col("code").alias("raw_code"), F.lit(True).alias("in_master"))
    joined = mentions.join(known, "raw_code", "left").join(
        verdicts.select("key", F.col("code").alias("_by_name"), F.col("reason").alias("_why")),
        "key",
        "left",
    )
    has_code = F.col("raw_code").isNotNull()
    from_text = F.coalesce(F.col("raw_source") == "text", F.lit(False))
    in_master = F.coalesce("in_master", F.lit(False))
    reason = (
        F.when(has_code & from_text & in_master, None)
        .when(has_code & ~from_text, "inferred_code")
        .when(has_code, "code_not_in_master")
        .when(F.col("_by_name").isNull(), F.coalesce("_why", F.lit("no_hit")))
    )
    return (
        joined.withColumn("in_master", in_master)
        .withColumn("reason", reason)
        .withColumn(
            "target_code",
            F.when(F.col("reason").isNull(), F.when(has_code, F.col("raw_code")).otherwise(F.col("_by_name"))),
        )
        .withColumn("code_source", F.when(F.col("reason").isNull(), "text").otherwise(F.col("raw_source")))
        .drop("_by_name", "_why")
    )


def inferred_candidates(
    routed: DataFrame, verdicts: DataFrame, candidates: DataFrame, hints: int | None
) -> DataFrame:
    """The first ``hints`` hints per distinct (key, inferred code); None: all of them.

    The own code leads if the master knows it and the name did not already bring it; an
    automatic hit of the name counts 1.0; then the hints of the name in their order.
    """
    asked = routed.where("raw_code IS NOT NULL AND reason = 'inferred_code'").select("key", "raw_code", "in_master").distinct()
    automatic = verdicts.where("code IS NOT NULL").select("key", "code", F.lit(1.0).alias("score"))
    listed = candidates.select("key", "code", "score").join(
        verdicts.select("key", "reason"), "key"
    ).withColumn(
        # several hits are listed by code, near hints by score
        "place", F.when(F.col("reason") == "no_hit", 1 - F.col("score")).otherwise(F.lit(0.0))
    ).drop("reason")
    by_name = automatic.withColumn("place", F.lit(0.0)).unionByName(listed)
    in_list = W.partitionBy("key").orderBy("place", "code")
    short = by_name.withColumn("rank", F.row_number().over(in_list)).drop("place")
    if hints is not None:
        short = short.where(F.col("rank") <= hints)
    # whether the name already brought the own code is asked of the whole list; the mentions are
    # routed once, so each asks for its own code and for the list of its name in one row each
    brought = by_name.select("key", F.col("code").alias("raw_code")).distinct().withColumn("brought", F.lit(True))
    alone = F.col("in_master") & F.col("brought").isNull()
    asked = asked.join(brought, ["key", "raw_code"], "left").withColumn(
        "own", F.explode(F.when(alone, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    )
    listed = (
        asked.join(short.withColumnsRenamed({"key": "_key"}), (F.col("key") == F.col("_key")) & ~F.col("own"), "left")
        .where(F.col("own") | F.col("_key").isNotNull())
        .select(
            "key",
            "raw_code",
            F.when(F.col("own"), F.col("raw_code")).otherwise(F.col("code")).alias("code"),
            F.when(F.col("own"), F.lit(1.0)).otherwise(F.col("score")).alias("score"),
            F.when(F.col("own"), F.lit(0)).otherwise(F.col("rank")).alias("rank"),
        )
    )
    per_mention = W.partitionBy("key", "raw_code").orderBy("rank")
    listed = listed.withColumn("rank", F.row_number().over(per_mention))
    return listed if hints is None else listed.where(F.col("rank") <= hints)


def reuse_decisions(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply final decisions of earlier versions of the same report, by (name key, raw code).

    An automatic result beats both; a confirmation sets the code; a dismissal makes the new
    review row already dismissed. The latest decision per key counts.
    """
    key = ["report_id", "key", "_code"]
    final = (
        decisions.where(F.col("status").isin("confirmed", "dismissed"))
        .withColumn("_code", F.coalesce("raw_code", F.lit("")))
        .groupBy(*key)
        .agg(F.max_by(F.struct("status", "resolved_code", "match_id"), "match_id").alias("_d"))
    )
    auto = F.col("reason").isNull()
    confirmed = F.col("_d.status") == "confirmed"
    return (
        routed.withColumn("_code", F.coalesce("raw_code", F.lit("")))
        .join(final, key, "left")
        .withColumn(
            "match_status",
            F.when(auto, None).when(confirmed, None).when(F.col("_d.status") == "dismissed", "dismissed").otherwise("pending"),
        )
        .withColumn("match_id", F.when(~auto & confirmed, F.col("_d.match_id")))
        .withColumn(
            "target_code",
            F.when(auto, F.col("target_code")).when(confirmed, F.col("_d.resolved_code")),
        )
        .withColumn(
            "code_source",
            F.when(~auto & confirmed, "manually_confirmed").otherwise(F.col("code_source")),
        )
        .drop("_code", "_d")
    )


def supersede_pending(matches: DataFrame, reanalysed: DataFrame) -> DataFrame:
    """Open review rows of reanalysed reports become superseded."""
    touched = reanalysed.select("report_id").distinct().withColumn("_again", F.lit(True))
    return (
        matches.join(touched, "report_id", "left")
        .withColumn(
            "status",
            F.when((F.col("status") == "pending") & F.col("_again"), "superseded").otherwise(
                F.col("status")
            ),
        )
        .drop("_again")
    )


def apply_decisions(
    decisions: DataFrame, matches: DataFrame, codes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(verdict per decision, changed review rows) for decisions (arrival, match_id, action, code).

    Only an open row can be decided, a confirmed code must be in the master. The first valid
    decision of a row counts; every later one finds the row closed.
    """
    known = codes.select("code", F.lit(True).alias("_known"))
    open_rows = matches.select("match_id", F.col("status").alias("_status"))
    checked = decisions.join(known, "code", "left").join(open_rows, "match_id", "left")
    valid = (F.col("_status") == "pending") & (
        (F.col("action") == "dismiss") | F.coalesce("_known", F.lit(False))
    )
    first = checked.where(valid).groupBy("match_id").agg(F.min("arrival").alias("_first"))
    judged = (
        checked.join(first, "match_id", "left")
        .withColumn(
            "verdict",
            F.when(F.col("_status").isNull(), "not_found")
            .when((F.col("_status") != "pending") | (F.col("arrival") > F.col("_first")), "already_resolved")
            .when(F.col("arrival") == F.col("_first"), "applied")
            .otherwise("unknown_code"),
        )
        .drop("_known", "_status", "_first")
    )
    confirm = F.col("action") == "confirm"
    changes = judged.where("verdict = 'applied'").select(
        "match_id",
        F.when(confirm, "confirmed").otherwise("dismissed").alias("status"),
        F.when(confirm, F.col("code")).alias("resolved_code"),
        "arrival",
    )
    return judged, changes


def apply_to_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Target links after review: confirmed rows get the code, dismissed rows lose theirs."""
    hit = changes.select("match_id", F.col("status").alias("_s"), "resolved_code")
    return (
        links.join(hit, "match_id", "left")
        .withColumn("target_code", F.when(F.col("_s").isNull(), F.col("target_code")).otherwise(F.col("resolved_code")))
        .withColumn("code_source", F.when(F.col("_s") == "confirmed", "manually_confirmed").otherwise(F.col("code_source")))
        .drop("_s", "resolved_code")
    )
