"""The planner against a plain loop over random documents."""

import random

from folioflow.plans import budget as B


def loop_zones(costs, budget):
    n, total = len(costs), sum(costs)
    if total <= budget:
        return ["full"] * n
    head, tail = int(0.6 * budget), max(int(0.4 * budget), 200)
    used = k = 0
    while k < n and used + costs[k] <= head:
        used += costs[k]
        k += 1
    allow = min(tail, max(budget - used, 0))
    j, back = n, 0
    while j > k and back + costs[j - 1] <= allow:
        back += costs[j - 1]
        j -= 1
    if n == 1:
        return ["single"]
    out = ["head"] * k + ["mid"] * (j - k) + ["tail"] * (n - j)
    if k == 0 and j > 0:
        out[0] = "head_win"
    if j == n and n - 1 > max(k - 1, 0) and (allow > 0 or k == 0):
        out[-1] = "tail_win"
    return out


def test_zones(spark):
    rnd, docs = random.Random(5), []
    for d in range(120):
        docs.append([rnd.choice(["", "w " * rnd.randint(0, 300), "w " * rnd.randint(0, 3000)]) for _ in range(rnd.randint(1, 9))])
    rows = [(d, k, f"=== [s {k}] ===", body, None) for d, bodies in enumerate(docs) for k, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id long, section_idx int, anchor string, body string, fetch_hint string")
    for budget in (200, 700, 2500):
        got = {(r.doc_id, r.section_idx): (r.zone, r.cost) for r in B.zones(df, budget).collect()}
        for d, bodies in enumerate(docs):
            want = loop_zones([got[d, k][1] for k in range(len(bodies))], budget)
            assert [got[d, k][0] for k in range(len(bodies))] == want, (d, budget)


def test_footer_is_last(spark):
    df = spark.createDataFrame([(1, 0, "=== [text] ===", "hello", "--full")], "doc_id long, section_idx int, anchor string, body string, fetch_hint string")
    row = B.assemble(df, 10_000).first()
    assert row.text == f"=== [text] ===\nhello\n{B.FOOTER}" and row.strategy == "full" and row.untrusted_notice


def test_cjk_window_and_long_sample(spark):
    from pyspark.sql import functions as F

    from folioflow.functions import text as X

    df = spark.createDataFrame([("漢" * 120_000,), ("word " * 100_000,)], "t string")
    out = df.select(X.est_tokens(F.col("t")).alias("n"), X.est_tokens(X.window_body(F.col("t"), F.lit(1000))).alias("cut")).collect()
    assert out[0].n == int(120_000 * 1.05 + 1) and out[0].cut <= 1800
    assert abs(out[1].n - 125_000) < 1000 and out[1].cut < 1200
