"""Company resolution against brute force and hand-made cases."""

import random
from difflib import SequenceMatcher

import pytest

from dossier.operators import master, resolve


def names(rng, n, alphabet, most):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize("threshold", [0.85, 0.5])
@pytest.mark.parametrize("alphabet,most", [("abcd", 9), ("abcdefghijklmnopqrst", 12), ("一二三四五六七八九十甲乙丙丁", 6)])
def test_similar_pairs_miss_nothing(spark, threshold, alphabet, most):
    rng = random.Random(len(alphabet))
    left, right = names(rng, 70, alphabet, most), names(rng, 90, alphabet, most)
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    got = {(r.name, r.entry): round(r.score, 9) for r in resolve.similar_pairs(frame(left), frame(right), threshold).collect()}
    want = {}
    for a in left:
        for b in right:
            score = SequenceMatcher(None, a, b).ratio()
            if score >= threshold:
                want[(a, b)] = round(score, 9)
    assert got == want and want


def plain_by_name(key, entries):
    """(code, reason, candidates) as the waterfall defines it, name by name."""
    if not key:
        return None, "no_hit", []
    exact = sorted(c for k, c in entries if k == key)
    if exact:
        return (exact[0], None, []) if len(exact) == 1 else (None, "multi_candidate", [(c, 1.0) for c in exact])
    best = {}
    for k, c in entries:
        best[c] = max(best.get(c, 0.0), SequenceMatcher(None, key, k).ratio())
    hits = sorted((c, s) for c, s in best.items() if s >= 0.85)
    if hits:
        return (hits[0][0], None, []) if len(hits) == 1 else (None, "multi_candidate", [(c, round(s, 3)) for c, s in hits])
    near = sorted(((c, s) for c, s in best.items() if s > 0.5), key=lambda x: (-x[1], x[0]))[:3]
    return None, "no_hit", [(c, round(s, 3)) for c, s in near]


def test_waterfall_against_brute_force(spark):
    rng = random.Random(3)
    keys = names(rng, 60, "abcde", 10)
    entries = sorted({(k, f"{rng.randint(0, 40):06d}") for k in keys for _ in range(2)})
    asked = names(rng, 80, "abcde", 10) + keys[:10] + [""]
    work = []
    verdicts, candidates = resolve.resolve_names(
        spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame(entries, "key string, code string"), 3, work
    )
    # a threshold is asked only by the names that the one before left open
    assert [w["threshold"] for w in work] == [0.85, 0.75, 0.65, 0.5]
    assert [w["names"] for w in work] == sorted((w["names"] for w in work), reverse=True) and all(w["pairs"] <= w["names"] * len(keys) for w in work)
    hints = {}
    for r in candidates.collect():
        hints.setdefault(r.key, []).append((r.code, r.score))
    got = {r.key: (r.code, r.reason, sorted(hints.get(r.key, []))) for r in verdicts.collect()}
    want = {}
    for a in set(asked):
        code, reason, cand = plain_by_name(a, entries)
        want[a] = (code, reason, sorted(cand))
    assert got == want


def test_all_hints_where_none_are_cut(spark):
    rng = random.Random(8)
    entries = sorted({(k, f"{rng.randint(0, 90):06d}") for k in names(rng, 60, "abcde", 8) for _ in range(2)})
    asked = [a for a in names(rng, 40, "abcde", 8) if a not in {k for k, _ in entries}]
    frame = spark.createDataFrame(entries, "key string, code string")
    verdicts, candidates = resolve.fuzzy_stage(spark.createDataFrame([(a,) for a in asked], "key string"), frame, None)
    no_hit = {r.key for r in verdicts.where("reason = 'no_hit'").collect()}
    want = {}
    for a in no_hit:
        for k, c in entries:
            score = SequenceMatcher(None, a, k).ratio()
            if score > 0.5:
                want[a, c] = max(want.get((a, c), 0), round(score, 3))
    assert {(r.key, r.code): r.score for r in candidates.collect() if r.key in no_hit} == want and want


def test_code_routing_and_hints(spark):
    verdicts = spark.createDataFrame(
        [("auto", "000001", None), ("many", None, "multi_candidate"), ("none", None, "no_hit")], "key string, code string, reason string"
    )
    candidates = spark.createDataFrame(
        [("many", f"00001{i}", 1.0) for i in range(7)] + [("none", "000030", 0.6), ("none", "000020", 0.7)], "key string, code string, score double"
    )
    codes = spark.createDataFrame([("000001",), ("000002",), ("000016",)], "code string")
    mentions = spark.createDataFrame(
        [
            (1, "auto", "000002", "text"), (2, "auto", "999999", "text"), (3, "auto", "000002", "inferred"), (4, "many", "000016", None),
            (5, "many", "000002", "inferred"), (6, "none", "999999", "inferred"), (7, "auto", None, None), (8, "many", None, None), (9, "auto", "000001", "inferred"),
        ],
        "id int, key string, raw_code string, raw_source string",
    )
    routed = resolve.route_mentions(mentions, verdicts, codes)
    assert {r.id: (r.target_code, r.code_source, r.reason) for r in routed.collect()} == {
        1: ("000002", "text", None), 2: (None, "text", "code_not_in_master"), 3: (None, "inferred", "inferred_code"), 4: (None, None, "inferred_code"),
        5: (None, "inferred", "inferred_code"), 6: (None, "inferred", "inferred_code"), 7: ("000001", "text", None), 8: (None, None, "multi_candidate"), 9: (None, "inferred", "inferred_code"),
    }
    hints = {}
    for r in resolve.inferred_candidates(routed, verdicts, candidates, 5).orderBy("rank").collect():
        hints.setdefault((r.key, r.raw_code), []).append((r.code, r.score))
    assert hints == {
        ("auto", "000002"): [("000002", 1.0), ("000001", 1.0)],
        # the own code is among the seven, so it does not lead, and the list ends after five
        ("many", "000016"): [(f"00001{i}", 1.0) for i in range(5)],
        ("many", "000002"): [("000002", 1.0)] + [(f"00001{i}", 1.0) for i in range(4)],
        ("none", "999999"): [("000020", 0.7), ("000030", 0.6)],
        ("auto", "000001"): [("000001", 1.0)],
    }
    whole = resolve.inferred_candidates(routed, verdicts, candidates, None).groupBy("key", "raw_code").count().collect()
    assert {(r.key, r.raw_code): r["count"] for r in whole}[("many", "000002")] == 8


def test_review_closes_a_row_once(spark):
    matches = spark.createDataFrame([(1, "pending"), (2, "confirmed"), (3, "pending")], "match_id int, status string")
    codes = spark.createDataFrame([("000001",)], "code string")
    decisions = spark.createDataFrame(
        [(1, 1, "confirm", "999999"), (2, 1, "confirm", "000001"), (3, 1, "dismiss", None), (4, 2, "dismiss", None), (5, 9, "dismiss", None), (6, 3, "dismiss", None)],
        "arrival int, match_id int, action string, code string",
    )
    judged, changes = resolve.apply_decisions(decisions, matches, codes)
    assert {r.arrival: r.verdict for r in judged.collect()} == {
        1: "unknown_code", 2: "applied", 3: "already_resolved", 4: "already_resolved", 5: "not_found", 6: "applied",
    }
    links = spark.createDataFrame([(1, None, None), (3, "000005", "text"), (4, "000006", "text")], "match_id int, target_code string, code_source string")
    after = {r.match_id: (r.target_code, r.code_source) for r in resolve.apply_to_links(links, changes).collect()}
    assert after == {1: ("000001", "manually_confirmed"), 3: (None, "text"), 4: ("000006", "text")}


def test_master_upsert_is_idempotent(spark):
    empty = spark.createDataFrame(
        [], "code string, name string, name_norm string, exchange string, l1_code string, l1_name string, l2_code string, l2_name string, "
        "l3_code string, l3_name string, effective_date date, historical_names array<string>",
    )
    stocks = spark.createDataFrame([("600000", "浦发 银行股份有限公司"), ("bad", "x")], "code string, name string")
    names_ = spark.createDataFrame([("01", "a", "0101", "b", "010101", "c")], "l1_code string, l1_name string, l2_code string, l2_name string, l3_code string, l3_name string")
    rows = spark.sql(
        "SELECT * FROM VALUES ('600000', DATE '2020-01-01', TIMESTAMP '2020-01-02', '010101'), ('600000', DATE '2020-01-01', NULL, '990101'), ('000009', DATE '2019-01-01', NULL, '990102') AS t(code, effective_date, source_updated_at, industry_code)"
    )
    industry = master.latest_industry(rows, names_)
    once = master.upsert_master(empty, stocks, industry)
    twice = master.upsert_master(once, stocks, industry)
    want = [("000009", "", "", "", "9901", None), ("600000", "浦发 银行股份有限公司", "浦发银行", "SH", "0101", "b")]
    shown = lambda df: [(r.code, r.name, r.name_norm, r.exchange, r.l2_code, r.l2_name) for r in df.orderBy("code").collect()]
    assert shown(once) == want and shown(twice) == want
