from __future__ import annotations

import random
from collections import defaultdict

from quarryline.llm.topn import largest_files, top_n


def test_top_n_against_sorting(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "hot", "hot", "hot", "a", "b"]), rnd.choice([None, 1, 2, 2, 3, -(2**63), 2**63 - 1]), rnd.choice(["x", "y", None]), i % 40, "e") for i in range(2000)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "g string, score bigint, tie string, id bigint, rank string").drop("rank")
    want = defaultdict(list)
    for g, s, t, i, _ in rows:
        if s is not None:
            want[g].append((-s, t is not None, t or "", i))
    want = {g: sorted(v)[:5] for g, v in want.items()}
    got = defaultdict(list)
    for r in sorted(top_n(df, ["g"], "score", ["tie", "id"], 5).collect(), key=lambda r: (str(r.g), r["rank"])):
        got[r.g].append((-r.score, r.tie is not None, r.tie or "", r.id))
        assert r["rank"] == len(got[r.g])
    assert dict(got) == want
    assert top_n(df.limit(0), ["g"], "score", ["id"], 2).collect() == []
    half = top_n(df.selectExpr("g", "cast(score as double) score", "id"), ["g"], "score", ["id"], 1).collect()
    assert {r.g: r.score for r in half} == {g: float(-v[0][0]) for g, v in want.items()}


def test_largest_files(spark):
    rows = [(1, "v", 5, "/b", 10, False, 1), (1, "v", 5, "/b", 99, False, 0), (2, "v", 5, "/a", 10, False, 1), (3, "v", 5, "/c", 10, None, 1), (4, "v", 5, "/d", 50, True, 1), (5, "v", 5, "/e", None, False, 1), (6, "v", 5, "/B", 10, False, 1), (7, None, None, "/z", 1, False, 1)]
    df = spark.createDataFrame(rows, "id bigint, volume_id string, parent_id bigint, path string, size bigint, is_dir boolean, changed_ns bigint")
    assert sorted((r.id, r["rank"]) for r in largest_files(df).collect()) == [(1, 3), (2, 2), (6, 1), (7, 1)]


def test_heaps_are_built_before_the_shuffle(spark):
    """The aggregate is an internal one of Spark: what it has to be is a partial heap, an exchange, a merged heap."""
    plan = top_n(spark.range(10).selectExpr("id % 2 g", "id score", "id"), ["g"], "score", ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    partial, final = plan.index("partial_collect_top_k"), plan.index("collect_top_k")
    assert final < plan.index("Exchange hashpartitioning") < partial
