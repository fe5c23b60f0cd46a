"""Batch forms of rules that are defined one by one, against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import identity, numbering, vocabulary

THEME = "id long, name string, name_norm string, status string, synonyms array<string>, source string, seed_code string, merged_into_id long"


def test_numbering_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(0, 500)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, x int")
    got = numbering.numbered_within(df, ["g"], [F.col("x"), F.col("i")], "n").collect()
    want = {}
    for g in "ab":
        for n, r in enumerate(sorted((x, i) for g2, i, x in rows if g2 == g), 1):
            want[(g, r[1])] = n
    assert {(r.g, r.i): r.n for r in got} == want
    ids = numbering.consecutive_ids(df, "i", F.lit(10), "id").collect()
    assert {r.i: r.id for r in ids} == {i: i + 10 for i in range(400)}


@pytest.mark.parametrize("kind", ["sparse", "equal", "hot", "null"])
def test_numbering_of_odd_values(spark, kind):
    rng = random.Random(kind)
    value = {
        "sparse": lambda i: i * rng.randint(1, 9) * 10**14, "equal": lambda i: 7,
        "hot": lambda i: 5 if rng.random() < 0.9 else rng.randint(-50, 50), "null": lambda i: None if i % 3 else i,
    }[kind]
    rows = [(i, value(i), f"t{rng.randint(0, 9)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, x long, t string").repartition(7)
    ids = {r.i: r.id for r in numbering.consecutive_ids(df, "x", F.lit(100), "id", ("t", "i")).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    assert ids == {r[0]: 100 + n for n, r in enumerate(ordered)}
    # without ties that decide, numbers are still consecutive and follow the value; equal values spread over ranges
    loose = numbering.numbered(df, [F.col("x")], "n").collect()
    assert sorted(r.n for r in loose) == list(range(1, 4001))
    shown = [r.x for r in sorted(loose, key=lambda r: r.n)]
    assert shown == sorted(shown, key=lambda x: (x is not None, x or 0))
    within = numbering.numbered_within(df, ["x"], [F.col("i")], "n").collect()
    seen = {}
    for i, x, _ in sorted(rows):
        seen[x] = seen.get(x, 0) + 1
        assert next(r.n for r in within if r.i == i) == seen[x] if i % 400 == 0 else True


def test_a_frequent_value_is_split_between_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("id", "1 AS x").repartition(7)
        keyed = df.selectExpr("*", "xxhash64(id, x) AS h").repartitionByRange("x", "h")
        sizes = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
        assert sorted(r.n for r in numbering.numbered(df, [F.col("x")], "n").collect()) == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_dispositions_one_by_one(spark):
    rng = random.Random(2)
    live = [(100 + i, f"t{i}", "b", "d") for i in range(3)]
    refs = [(p, f"t{rng.randint(0, 12)}", "b", "d", rng.random() < 0.7, rng.random() < 0.7) for p in range(120)]
    stored = {row[1:]: row[0] for row in live}
    next_id, want = 103, {}
    for p, *key, auto, ok in refs:
        key = tuple(key)
        if key in stored:
            want[p] = ("duplicate", stored[key])
        elif auto and ok:
            stored[key] = next_id
            want[p] = ("ingested", next_id)
            next_id += 1
        else:
            want[p] = ("fetch_failed" if auto else "seen", None)
    got = identity.dispose_references(
        spark.createDataFrame(refs, "position long, title_norm string, broker string, publish_date string, auto_download boolean, fetch_ok boolean"),
        spark.createDataFrame(live, "id long, title_norm string, broker string, publish_date string"),
        spark.createDataFrame(live, "id long, title_norm string, broker string, publish_date string"),
    )
    assert {r.position: (r.status, r.report_id) for r in got.collect()} == want


def test_restore_window_is_strict(spark):
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    reports = spark.sql(
        "SELECT * FROM VALUES (1, 'a', 'b', DATE '2024-01-01', TIMESTAMP '2024-03-01'), (2, 'c', 'b', DATE '2024-01-01', TIMESTAMP '2024-02-29 23:59:59'),"
        "(3, 'd', 'b', DATE '2024-01-01', TIMESTAMP '2024-03-30'), (4, 'd', 'b', DATE '2024-01-01', NULL) AS t(id, title_norm, broker, publish_date, deleted_at)"
    )
    asked = spark.createDataFrame([(i,) for i in range(1, 6)], "report_id int")
    got = {r.report_id: r.verdict for r in identity.restore_eligibility(asked, reports, now, 30).collect()}
    assert got == {1: "ok", 2: "window_passed", 3: "identity_live_again", 4: "not_deleted", 5: "missing"}


def test_unlink_and_relink(spark):
    tags = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, name string")
    links = spark.createDataFrame([(7, 1), (7, 2)], "report_id long, tag_id long")
    ask = lambda *rows: spark.createDataFrame(list(rows), "arrival long, report_id long, raw_name string")
    left = identity.unlink_tags(ask((1, 7, " a　b ")), tags, links)
    assert [(r.report_id, r.tag_id) for r in left.collect()] == [(7, 2)]
    new_tags, new_links = identity.link_tags(ask((1, 7, "c"), (2, 8, "new"), (3, 9, "NEW"), (4, 8, " new "), (5, 8, " ")), tags, links)
    assert sorted((r.id, r.name) for r in new_tags.collect()) == [(3, "new"), (4, "NEW")]
    assert sorted((r.report_id, r.tag_id) for r in new_links.collect()) == [(8, 3), (9, 4)]


def themes(spark, rows):
    return spark.createDataFrame([(i, n, n.replace(" ", ""), s, syn, src, code, m) for i, n, s, syn, src, code, m in rows], THEME)


def test_active_beats_pending_and_lowest_id_wins(spark):
    vocab = themes(spark, [
        (1, "A", "pending", ["S1"], "x", None, None), (2, "B", "active", ["A", "ＡＩ 算力"], "x", None, None),
        (3, "C", "active", ["A", "B"], "x", None, None), (4, "D", "retired", [], "x", None, None), (5, "S1x", "pending", None, "x", None, None),
    ])
    got = {r.key: r.theme_id for r in vocabulary.dictionary(vocab).collect()}
    assert got == {"A": 2, "B": 2, "AI算力": 2, "C": 3, "S1x": 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_ends(spark, seed):
    rng = random.Random(seed)
    to = {i: (rng.randint(0, 60) if rng.random() < 0.75 else None) for i in range(60)}

    def end(i):
        seen = set()
        while to.get(i) is not None and i not in seen and to[i] in to:
            seen.add(i)
            i = to[i]
        return i

    df = spark.createDataFrame([(i, t) for i, t in to.items()], "id long, merged_into_id long")
    assert {r.id: r.root_id for r in vocabulary.chain_roots(df).collect()} == {i: end(i) for i in to}


def test_proposals_one_by_one(spark):
    rows = [
        (1, "act", "active", ["syn"], "x", None, None), (2, "pend", "pending", [], "x", None, None), (3, "ret", "retired", [], "x", None, None),
        (4, "m1", "merged", [], "x", None, 3), (5, "m2", "merged", [], "x", None, 1), (6, "m3", "merged", [], "x", None, 4), (7, "ret2", "retired", [], "x", None, None),
    ]
    rng = random.Random(5)
    for _ in range(3):
        names = [rng.choice(["act", "syn", "pend", "ret", "m1", "m2", "m3", "ret2", "n1", "n 1", "n2", " "]) for _ in range(25)]
        state = {r[0]: [r[1], r[2], r[6]] for r in rows}
        want = []
        for name in names:
            key = name.replace(" ", "")
            keyed = lambda s: [i for i in sorted(state) if state[i][1] == s and state[i][0].replace(" ", "") == key]
            if not key:
                want.append("empty_name")
            elif keyed("active") or key == "syn":
                want.append("conflict_active")
            elif keyed("pending"):
                want.append("conflict_pending")
            else:
                holder = next((i for i in state if state[i][0].replace(" ", "") == key), None)
                if holder is None:
                    state[max(state) + 1] = [name, "pending", None]
                    want.append("created")
                else:
                    while state[holder][2] is not None:
                        holder = state[holder][2]
                    if state[holder][1] == "retired":
                        state[holder][1] = "pending"
                        want.append("revived")
                    else:
                        want.append("led_to_root")
        asked = spark.createDataFrame(list(enumerate(names)), "arrival long, name string")
        got = {r.arrival: r.verdict for r in vocabulary.propose(asked, themes(spark, rows)).collect()}
        assert [got[i] for i in range(len(names))] == want


def plain_import(seeds, rows):
    state = {r[0]: {"name": r[1], "status": r[2], "key": (r[4], r[5])} for r in rows}
    out = {}
    for position, source, code, name in seeds:
        norm = name.replace(" ", "")
        theme = next((i for i, s in state.items() if s["key"] == (source, code) and code), None)
        holder = next((i for i, s in state.items() if s["name"].replace(" ", "") == norm), None)
        if theme is not None and state[theme]["status"] != "active":
            out[position] = ("theme_closed", theme)
        elif theme is None and holder is not None:
            out[position] = ("name_taken", None)
        elif theme is None:
            new = max(state) + 1
            state[new] = {"name": name, "status": "active", "key": (source, code)}
            out[position] = ("created", new)
        elif state[theme]["name"] == name:
            out[position] = ("kept", theme)
        elif holder is None or holder == theme:
            state[theme]["name"] = name
            out[position] = ("renamed", theme)
        else:
            out[position] = ("rename_blocked", theme)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_seed_import_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, f"n{i}" + (" " if rng.random() < 0.3 else "") + "x", rng.choice(["active"] * 4 + ["retired"]), [], "em", f"c{i}" if i % 4 else None, None)
        for i in range(1, 13)
    ]
    keys = [("em", f"c{i}") for i in range(1, 13)] + [("sw", f"s{i}") for i in range(8)]
    rng.shuffle(keys)
    seeds = [(p, s, c, f"n{rng.randint(1, 18)}" + (" " if rng.random() < 0.3 else "") + "x") for p, (s, c) in enumerate(keys)]
    got = vocabulary.seed_verdicts(spark.createDataFrame(seeds, "position long, source string, seed_code string, name string"), themes(spark, rows))
    assert {r.position: (r.verdict, r.theme_id) for r in got.collect()} == plain_import(seeds, rows)


def test_seed_members_leave_and_return(spark):
    today = lambda d: F.lit(d).cast("date")
    codes = spark.createDataFrame([("000001",), ("000002",), ("000003",)], "code string")
    members = spark.sql(
        "SELECT * FROM VALUES (1, '000001', 'seed', DATE '2023-01-01', true), (1, '000002', 'analysis', DATE '2023-01-01', true), (2, '000001', 'seed', DATE '2023-01-01', true) AS t(theme_id, target_code, source, joined_at, is_active)"
    )
    verdicts = spark.createDataFrame([(0, 1, "kept")], "position int, theme_id int, verdict string")
    step = lambda m, listed, day: vocabulary.seed_members(verdicts, spark.createDataFrame([(0, c) for c in listed], "position int, target_code string"), m, codes, today(day))
    shown = lambda m: sorted((r.theme_id, r.target_code, r.source, str(r.joined_at), r.is_active) for r in m.collect())
    left = step(members, ["000003", "999999", "bad"], "2024-01-01")
    assert shown(left) == [
        (1, "000001", "seed", "2023-01-01", False), (1, "000002", "analysis", "2023-01-01", True), (1, "000003", "seed", "2024-01-01", True), (2, "000001", "seed", "2023-01-01", True),
    ]
    back = step(left, ["000001", "000002"], "2024-02-01")
    assert shown(back) == [
        (1, "000001", "seed", "2023-01-01", True), (1, "000002", "analysis", "2023-01-01", True), (1, "000003", "seed", "2024-01-01", False), (2, "000001", "seed", "2023-01-01", True),
    ]


def test_merge_keeps_earlier_date_and_target_source(spark):
    vocab = themes(spark, [(1, "dst", "active", ["old", "src"], "x", None, None), (2, "src", "pending", ["Old", "o ld", "dst"], "x", None, None), (3, "gone", "retired", [], "x", None, None)])
    asked = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 3, 1), (4, 1, 1), (5, 2, 3)], "arrival long, src long, dst long")
    got = {r.arrival: r.verdict for r in vocabulary.merge_verdicts(asked, vocab).collect()}
    assert got[3] == "source_closed" and got[4] == "self" and got[5] == "target_not_active"
    legal = spark.createDataFrame([(1, 2, 1)], "arrival long, src long, dst long")
    assert {r.arrival: r.verdict for r in vocabulary.merge_verdicts(legal, vocab).collect()} == {1: "ok"}
    members = spark.sql(
        "SELECT * FROM VALUES (1, 'a', 'manual', DATE '2024-02-01', false), (2, 'a', 'seed', DATE '2024-01-01', true), (2, 'b', 'seed', DATE '2024-01-05', false) AS t(theme_id, target_code, source, joined_at, is_active)"
    )
    after = sorted((r.theme_id, r.target_code, r.source, str(r.joined_at), r.is_active) for r in vocabulary.merge_members(members, legal).collect())
    assert after == [(1, "a", "manual", "2024-01-01", True), (1, "b", "seed", "2024-01-05", False)]
    synonyms = vocabulary.merged_synonyms(vocab, legal).orderBy("position").collect()
    assert [r.synonym for r in synonyms] == ["old", "src", "Old"]
