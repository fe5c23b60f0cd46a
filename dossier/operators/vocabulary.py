"""Governed theme vocabulary: dictionary, merge chains, settling, governance, seeds, pools.

Theme rows: id, name, name_norm, status (pending/active/merged/retired), synonyms, source,
seed_code, merged_into_id. ``name_norm`` is unique. Results with lists come as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import valid_code
from ..functions.text import normalize_theme_name, strip
from ..session import cut_lineage
from .identity import _with_new_ids


def _names(column: str) -> Column:
    """A list column, empty instead of NULL."""
    return F.coalesce(column, F.array().cast("array<string>"))



def dictionary(themes: DataFrame) -> DataFrame:
    """key -> theme: names and synonyms of active themes beat names of pending ones; then the
    lowest id wins. Synonyms of pending themes do not match."""
    active = F.col("status") == "active"
    names = F.when(active, F.concat(F.array("name"), _names("synonyms"))).otherwise(
        F.array("name")
    )
    keyed = (
        themes.where(F.col("status").isin("active", "pending"))
        .select("id", "status", F.when(active, 0).otherwise(1).alias("tier"), F.explode(names).alias("n"))
        .select("id", "status", "tier", normalize_theme_name(F.col("n")).alias("key"))
        .where("key <> ''")
    )
    return (
        keyed.groupBy("key")
        .agg(F.min(F.struct("tier", "id", "status")).alias("best"))
        .select("key", F.col("best.id").alias("theme_id"), F.col("best.status").alias("theme_status"))
    )


def resolve_themes(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add theme_id (NULL = unknown) by the normalised raw name."""
    return raw.withColumn("key", normalize_theme_name(F.col("raw_name"))).join(
        vocabulary, "key", "left"
    )


def chain_roots(themes: DataFrame) -> DataFrame:
    """(id, root_id): the end of every merge chain, by pointer doubling.

    The number of rounds is the logarithm of the longest chain. A walk that would enter a cycle
    ends where it would step on a theme for the second time: at the entry of the cycle.
    """
    pairs = cut_lineage(
        themes.select("id", F.col("merged_into_id").alias("to")), "merge-chains"
    )
    ids = pairs.select(F.col("id").alias("to"))
    # links to themes that do not exist end the chain
    links = cut_lineage(pairs.join(ids, "to", "left_semi").select("id", "to"), "merge-chains")
    longest = max(1, links.count())

    def settle(step: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
        """(finished, still moving) after at most ``rounds`` doublings."""
        moving, done = step, None
        for _ in range(rounds):
            onward = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            doubled = moving.join(onward, "to", "left").select(
                "id", F.coalesce("next", "to").alias("to"), F.col("next").isNull().alias("end")
            )
            step = cut_lineage(doubled, "merge-chains")
            done, moving = step.where("end").drop("end"), step.where("NOT end").drop("end")
            step = step.drop("end")
            if moving.isEmpty():
                break
            moving = step
        return done, step.join(done.select("id"), "id", "left_anti")

    ended, circling = settle(links, longest.bit_length() + 1)
    if not circling.isEmpty():
        # after that many steps every walk stands inside its cycle, and every cycle is covered
        on_cycle = circling.select(F.col("to").alias("id")).distinct()
        opened = cut_lineage(links.join(on_cycle, "id", "left_anti"), "merge-chains")
        ended, _ = settle(opened, longest.bit_length() + 1)
    return pairs.select("id").join(ended, "id", "left").select(
        "id", F.coalesce("to", "id").alias("root_id")
    )


def settle_unknown(raw: DataFrame, themes: DataFrame) -> DataFrame:
    """Where unknown names go. ``raw``: arrival, raw_name, key (not in the dictionary).

    One row per key: unknown -> a new pending theme named as first written; a retired theme
    returns to pending; a merged one leads to its root, which returns to pending if it is retired.
    ``revived`` says that the theme's status changes and its review is cleared.
    """
    first = raw.where("key <> ''").groupBy("key").agg(
        F.min("arrival").alias("arrival"), F.min_by("raw_name", "arrival").alias("raw_name")
    )
    holders = themes.select(F.col("name_norm").alias("key"), F.col("id").alias("holder"))
    roots = chain_roots(themes).select(F.col("id").alias("holder"), "root_id")
    root_state = themes.select(F.col("id").alias("root_id"), F.col("status").alias("root_status"))
    known = cut_lineage(
        first.join(holders, "key", "left")
        .join(roots, "holder", "left")
        .join(root_state, "root_id", "left"),
        "unknown-themes",
    )
    old = known.where("holder IS NOT NULL").select(
        "key",
        "arrival",
        "raw_name",
        F.col("root_id").alias("theme_id"),
        F.lit(False).alias("created"),
        (~F.col("root_status").isin("active", "pending")).alias("revived"),
    )
    new = _with_new_ids(
        known.where("holder IS NULL").select("key", "arrival", "raw_name"), "arrival", themes, "id", "theme_id", ("key",)
    ).select(
        "key", "arrival", "raw_name", "theme_id", F.lit(True).alias("created"), F.lit(False).alias("revived")
    )
    return old.unionByName(new)


def propose(proposals: DataFrame, themes: DataFrame) -> DataFrame:
    """Verdict per proposal (arrival, name), as if handled in order of arrival.

    Conflicts with the dictionary are rejected; else the name settles like an unknown one. After
    that the theme is pending, so the same name proposed again conflicts with it - unless it is
    the name of a merged theme, which simply leads to the root.
    """
    named = proposals.select("arrival", strip(F.col("name")).alias("raw_name"))
    resolved = cut_lineage(resolve_themes(named, dictionary(themes)), "proposals")
    settled = settle_unknown(resolved.where("theme_id IS NULL AND key <> ''"), themes)
    own_key = themes.select(F.col("id").alias("_settled"), F.col("name_norm").alias("_own"))
    placed = cut_lineage(
        settled.select("key", F.col("theme_id").alias("_settled"), "created", "revived").join(
            own_key, "_settled", "left"
        ),
        "proposals",
    )
    # a root can be revived through several names; the first proposal does it
    openers = (
        resolved.where("theme_id IS NULL")
        .join(placed, "key")
        .groupBy("_settled")
        .agg(F.min("arrival").alias("_opened"))
    )
    joined = resolved.join(placed.join(openers, "_settled"), "key", "left")
    opens = F.col("arrival") == F.col("_opened")
    return joined.select(
        "arrival",
        F.coalesce("theme_id", "_settled").alias("theme_id"),
        F.when(F.col("key") == "", "empty_name")
        .when(F.col("theme_status") == "active", "conflict_active")
        .when(F.col("theme_status") == "pending", "conflict_pending")
        .when(opens & F.col("created"), "created")
        .when(opens & F.col("revived"), "revived")
        .when(F.col("created") | (F.col("revived") & (F.col("key") == F.col("_own"))), "conflict_pending")
        .otherwise("led_to_root")
        .alias("verdict"),
    )


def backfill_pool(theme_links: DataFrame, target_links: DataFrame, members: DataFrame, today: Column) -> DataFrame:
    """Members after linking: every theme x resolved code of one analysis is an active member.

    Both sides are distinct per analysis before they meet; new pairs join today.
    """
    pairs = (
        theme_links.select("analysis_id", "theme_id").distinct()
        .join(
            target_links.where("target_code IS NOT NULL").select("analysis_id", "target_code").distinct(),
            "analysis_id",
        )
        .select("theme_id", "target_code", F.lit(True).alias("_linked"))
        .distinct()
    )
    return members.join(pairs, ["theme_id", "target_code"], "full_outer").select(
        "theme_id",
        "target_code",
        F.coalesce("source", F.lit("analysis")).alias("source"),
        F.coalesce("joined_at", today).alias("joined_at"),
        (F.coalesce("_linked", F.lit(False)) | F.coalesce("is_active", F.lit(False))).alias("is_active"),
    )


def govern(requests: DataFrame, themes: DataFrame) -> DataFrame:
    """Legal or not, per request (arrival, theme_id, action = approve/retire), in order of arrival.

    Only a pending theme can be approved, so approval must be the first request of its theme;
    a pending or active theme can be retired once.
    """
    first = requests.groupBy("theme_id").agg(
        F.min("arrival").alias("_first"),
        F.min(F.when(F.col("action") == "retire", F.col("arrival"))).alias("_retired"),
    )
    state = themes.select(F.col("id").alias("theme_id"), F.col("status").alias("_status"))
    legal = F.when(
        F.col("action") == "approve",
        (F.col("_status") == "pending") & (F.col("arrival") == F.col("_first")),
    ).otherwise(
        F.col("_status").isin("pending", "active") & (F.col("arrival") == F.col("_retired"))
    )
    return (
        requests.join(first, "theme_id")
        .join(state, "theme_id", "left")
        .withColumn("legal", F.coalesce(legal, F.lit(False)))
        .withColumn(
            "new_status",
            F.when(~F.col("legal"), None).when(F.col("action") == "approve", "active").otherwise("retired"),
        )
        .drop("_first", "_retired", "_status")
    )


def union_synonyms(names: DataFrame, own: DataFrame) -> DataFrame:
    """(theme_id, position, synonym) in order, each normalised name once, the own name removed.

    ``names``: theme_id, position, name in the wanted order; ``own``: theme_id, name.
    """
    # equal spellings meet before they are trimmed and normalised
    spelled = names.groupBy("theme_id", F.coalesce("name", F.lit("")).alias("name")).agg(
        F.min("position").alias("position")
    )
    keyed = spelled.select("theme_id", "position", strip(F.col("name")).alias("synonym")).where(
        "synonym <> ''"
    ).withColumn("key", normalize_theme_name(F.col("synonym")))
    mine = own.select("theme_id", normalize_theme_name(F.col("name")).alias("key"))
    return (
        keyed.groupBy("theme_id", "key")
        .agg(F.min(F.struct("position", "synonym")).alias("s"))
        .join(mine, ["theme_id", "key"], "left_anti")
        .select("theme_id", "s.position", "s.synonym")
    )


def merge_verdicts(merges: DataFrame, themes: DataFrame) -> DataFrame:
    """Which merges (arrival, src, dst) are legal: dst active, src pending or active, not itself.

    Of the requests that the stored states allow, one batch merges each source once and never into
    a theme it merges away; refused requests hold nothing up.
    """
    state = lambda side: themes.select(F.col("id").alias(side), F.col("status").alias(f"{side}_status"))
    judged = (
        merges.join(state("src"), "src", "left")
        .join(state("dst"), "dst", "left")
        .withColumn(
            "refused",
            F.when(F.col("src") == F.col("dst"), "self")
            .when(F.coalesce(F.col("dst_status") != "active", F.lit(True)), "target_not_active")
            .when(~F.coalesce(F.col("src_status").isin("pending", "active"), F.lit(False)), "source_closed"),
        )
    )
    first = judged.where("refused IS NULL").groupBy("src").agg(F.min("arrival").alias("_first"))
    gone = first.select(F.col("src").alias("dst"), F.lit(True).alias("_gone"))
    return (
        judged.join(first, "src", "left")
        .join(gone, "dst", "left")
        .withColumn(
            "verdict",
            F.when(F.col("refused").isNotNull(), F.col("refused"))
            .when(F.col("_gone") | (F.col("arrival") > F.col("_first")), "later_batch")
            .otherwise("ok"),
        )
        .select("arrival", "src", "dst", "verdict")
    )


def merge_members(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Members after legal merges (src, dst): moved rows unite with rows of the target theme.

    On a clash: active if either is, the earlier joining date, the source of the target's row.
    """
    moves = merges.select(F.col("src").alias("theme_id"), "dst")
    moved = members.join(moves, "theme_id", "left").select(
        F.coalesce("dst", "theme_id").alias("theme_id"),
        "target_code",
        "source",
        "joined_at",
        "is_active",
        # the target's own row decides the source; among moved rows the lowest theme id
        F.struct(F.col("dst").isNotNull().alias("moved"), F.col("theme_id").alias("was")).alias("_rank"),
    )
    return moved.groupBy("theme_id", "target_code").agg(
        F.min_by("source", "_rank").alias("source"),
        F.min("joined_at").alias("joined_at"),
        F.bool_or("is_active").alias("is_active"),
    )


def repoint_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    moves = merges.select(F.col("src").alias("theme_id"), "dst")
    return (
        links.join(moves, "theme_id", "left")
        .withColumn("theme_id", F.coalesce("dst", "theme_id"))
        .drop("dst")
    )


def merged_synonyms(themes: DataFrame, merges: DataFrame) -> DataFrame:
    """Synonyms of merge targets: their own, then name and synonyms of each source in order."""
    numbered = lambda first: F.posexplode(first).alias("n", "name")
    names = F.concat(F.array("name"), _names("synonyms"))
    targets = themes.join(merges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    own = targets.select(
        F.col("id").alias("theme_id"), numbered(_names("synonyms"))
    ).select("theme_id", F.struct(F.lit(-1).cast("long").alias("arrival"), "n").alias("position"), "name")
    brought = (
        merges.join(themes.select(F.col("id").alias("src"), names.alias("_names")), "src")
        .select(F.col("dst").alias("theme_id"), F.col("arrival").cast("long").alias("arrival"), numbered("_names"))
        .select("theme_id", F.struct("arrival", "n").alias("position"), "name")
    )
    return union_synonyms(
        own.unionByName(brought), targets.select(F.col("id").alias("theme_id"), "name")
    )


def seed_verdicts(seeds: DataFrame, themes: DataFrame) -> DataFrame:
    """What happens to each seed (position, source, seed_code, name), as if imported in order.

    created / kept / renamed / rename_blocked / name_taken / theme_closed, with the theme it
    concerns. A rename frees the old name for later seeds. Which renames succeed follows from
    the timeline of every name: a claim succeeds if the event before it set the name free, or if
    it is the first event and nobody held the name. Renames that succeed add events, so the
    timelines are evaluated until the set of successful renames stays the same.
    """
    known = themes.where("seed_code IS NOT NULL").select(
        "source", "seed_code", F.col("id").alias("theme_id"), "status",
        F.col("name").alias("old_name"), F.col("name_norm").alias("old_norm"),
    )
    keyed = seeds.withColumn("norm", normalize_theme_name(F.col("name")))
    matched = cut_lineage(
        keyed.join(known, ["source", "seed_code"], "left").withColumn(
            "wish",
            F.when(F.col("theme_id").isNull(), "create")
            .when(F.col("status") != "active", "closed")
            .when(F.col("old_name") == F.col("name"), "keep")
            # same key, other spelling: the name never changes hands
            .when(F.col("old_norm") == F.col("norm"), "respell")
            .otherwise("rename"),
        ),
        "seeds",
    )
    held = themes.select(F.col("name_norm").alias("norm"), F.lit(True).alias("held")).distinct()
    claims = matched.where("wish IN ('create', 'rename')").select("norm", "position", F.lit(1).alias("claim"))
    timeline = W.partitionBy("norm").orderBy("position", "claim")

    def successful(freed: DataFrame) -> DataFrame:
        events = claims.unionByName(freed)
        before = F.lag("claim").over(timeline)
        return (
            events.withColumn("before", before)
            .join(held, "norm", "left")
            .where(
                (F.col("claim") == 1)
                & ((F.col("before") == 0) | (F.col("before").isNull() & F.col("held").isNull()))
            )
            .select("position")
        )

    renames = matched.where("wish = 'rename'").select("position", F.col("old_norm").alias("norm"))
    freed = renames.limit(0).select("norm", "position", F.lit(0).alias("claim"))
    while True:
        won = cut_lineage(successful(freed), "seeds")
        now_freed = renames.join(won, "position", "left_semi").select("norm", "position", F.lit(0).alias("claim"))
        if now_freed.exceptAll(freed).isEmpty() and freed.exceptAll(now_freed).isEmpty():
            break
        freed = cut_lineage(now_freed, "seeds")
    judged = matched.join(won.withColumn("_won", F.lit(True)), "position", "left")
    won_name = F.coalesce("_won", F.lit(False))
    verdict = (
        F.when(F.col("wish") == "closed", "theme_closed")
        .when(F.col("wish") == "keep", "kept")
        .when(F.col("wish") == "respell", "renamed")
        .when(F.col("wish") == "rename", F.when(won_name, "renamed").otherwise("rename_blocked"))
        .otherwise(F.when(won_name, "created").otherwise("name_taken"))
    )
    final = judged.withColumn("verdict", verdict).drop("_won", "wish", "old_norm", "status")
    created = _with_new_ids(
        final.where("verdict = 'created'").drop("theme_id"), "position", themes, "id", "theme_id"
    )
    return final.where("verdict <> 'created'").unionByName(created)


def seed_members(
    verdicts: DataFrame, seed_codes: DataFrame, members: DataFrame, codes: DataFrame, today: Column
) -> DataFrame:
    """Members after the import. ``seed_codes``: (position, target_code).

    Only members a seed brought in leave or return with the list; first joining dates stay;
    codes the master does not know are ignored.
    """
    imported = verdicts.where("verdict IN ('created', 'kept', 'renamed', 'rename_blocked')")
    listed = (
        seed_codes.where(valid_code(F.col("target_code")))
        .join(codes.select(F.col("code").alias("target_code")), "target_code", "left_semi")
        .join(imported.select("position", "theme_id"), "position")
        .select("theme_id", "target_code", F.lit(True).alias("_listed"))
        .distinct()
    )
    touched = imported.select("theme_id", F.lit(True).alias("_touched")).distinct()
    listed_now = F.coalesce("_listed", F.lit(False))
    return (
        members.join(listed, ["theme_id", "target_code"], "full_outer")
        .join(touched, "theme_id", "left")
        .select(
            "theme_id",
            "target_code",
            F.coalesce("source", F.lit("seed")).alias("source"),
            F.coalesce("joined_at", today).alias("joined_at"),
            F.when(F.col("is_active").isNull(), True)
            .when((F.col("source") == "seed") & F.coalesce("_touched", F.lit(False)), listed_now)
            .otherwise(F.col("is_active"))
            .alias("is_active"),
        )
    )


def industry_seeds(master: DataFrame, names: DataFrame) -> DataFrame:
    """(seed_code, name, member) per second-level industry; industries without members keep a row.

    Long form: one industry may hold a third of all securities.
    """
    level2 = names.select(F.col("l2_code").alias("seed_code"), F.col("l2_name").alias("name")).distinct()
    members = master.where("l2_code IS NOT NULL").select(
        F.col("l2_code").alias("seed_code"), F.col("code").alias("member")
    )
    return level2.join(members, "seed_code", "left")


def _ordered_words(themes: DataFrame, lists: list[Column]) -> DataFrame:
    words = F.concat(*lists)
    return themes.select("id", F.posexplode(words).alias("position", "word"))


def display_terms(themes: DataFrame) -> DataFrame:
    """Theme name and synonyms as written, each normalised term once, in order."""
    words = _ordered_words(themes, [F.array("name"), _names("synonyms")]).withColumn(
        "word", strip(F.coalesce("word", F.lit("")))
    ).where("word <> ''")
    return (
        words.groupBy("id", normalize_theme_name(F.col("word")).alias("key"))
        .agg(F.min(F.struct("position", "word")).alias("w"))
        .select("id", "w.position", F.col("w.word").alias("term"))
    )


def query_words(subscriptions: DataFrame, most: int | None = None) -> DataFrame:
    """Normalised name, synonyms and extra keywords, each once, in order; all or the first ``most``."""
    words = _ordered_words(subscriptions, [F.array("name"), _names("synonyms"), _names("keywords")])
    keyed = (
        words.select("id", "position", normalize_theme_name(F.col("word")).alias("word"))
        .where("word <> ''")
        .groupBy("id", "word")
        .agg(F.min("position").alias("position"))
    )
    place = F.row_number().over(W.partitionBy("id").orderBy("position"))
    placed = keyed.withColumn("place", place).drop("position")
    return placed if most is None else placed.where(F.col("place") <= most)
