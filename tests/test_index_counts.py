"""Token counts of the text index: whole for every report, and no token is exchanged to be counted."""

from collections import Counter

from dossier.operators import retrieval


def _frames(spark, titles, bodies):
    none = spark.createDataFrame([], "report_id long, summary string")
    return (
        spark.createDataFrame(titles, "id long, title string"),
        spark.createDataFrame(bodies, "report_id long, body string"),
        none,
    )


def test_counts_of_unique_repeated_and_null_reports(spark):
    # the long body spans several slices of tokens; report 2 and NULL come in several rows
    titles = [(1, "Chip chip OUTLOOK"), (2, "a"), (2, "a b"), (4, "?!"), (5, None)]
    bodies = [(1, "word other " * 200_000), (2, "x x y"), (2, "x 中芯国际"), (None, "n m"), (None, "n"), (3, "")]
    words = {
        (1, "A"): ["chip", "chip", "outlook"], (2, "A"): ["a", "a", "b"], (1, "B"): ["word", "other"] * 200_000,
        (2, "B"): ["x", "x", "y", "x", "中芯", "芯国", "国际"], (None, "B"): ["n", "m", "n"],
    }
    want = Counter({(r, t, f, n): 1 for (r, f), ts in words.items() for t, n in Counter(ts).items()})
    got = retrieval.build_postings(*_frames(spark, titles, bodies))
    assert got.columns == ["report_id", "token", "field", "tf"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_tokens_of_a_report_are_counted_within_its_row(spark):
    plan = retrieval.build_postings(*_frames(spark, [(1, "a")], [(1, "b")]))._jdf.queryExecution().optimizedPlan().toString()
    # before, every single token was a row that went through an aggregate by (report, token, field)
    assert "Generate explode" not in plan
    counted = [line for line in plan.splitlines() if "Aggregate" in line and "token" in line]
    assert len(counted) == 1 and "(_rows" in plan
