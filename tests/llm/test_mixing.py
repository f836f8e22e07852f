import itertools
import random

import pytest
from polyquill.llm import mixing


def cost(flow, steps):
    total, past = 0, 0
    for capacity, unit in steps:
        part = max(0, min(flow - past, capacity))
        total += part * unit
        past += capacity
    return total


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(25):
        steps = {("in", "p"): [(9, 0.0)], ("in", "q"): [(9, 0.0)], ("p", "a"): [(r.randint(0, 3), 0.0), (3, 1.0)], ("p", "b"): [(r.randint(0, 3), 0.0), (3, 2.0)], ("q", "b"): [(2, 0.0), (2, 1.0)], ("a", "out"): [(r.randint(0, 4), 0.0), (4, 9.0)], ("b", "out"): [(3, 0.0), (3, 7.0)]}
        cap = {k: sum(c for c, _ in v) for k, v in steps.items()}
        best = {}
        for pa, pb, qb in itertools.product(range(cap["p", "a"] + 1), range(cap["p", "b"] + 1), range(cap["q", "b"] + 1)):
            f = {("p", "a"): pa, ("p", "b"): pb, ("q", "b"): qb, ("a", "out"): pa, ("b", "out"): pb + qb, ("in", "p"): pa + pb, ("in", "q"): qb}
            if all(f[k] <= cap[k] for k in f):
                n = pa + pb + qb
                best[n] = min(best.get(n, 1e9), sum(cost(f[k], steps[k]) for k in f))
        want = r.randint(1, 8)
        arcs = {k: mixing.ConvexArc(v) for k, v in steps.items()}
        sent = mixing.min_cost_flow(arcs, "in", "out", want)
        assert sent == min(want, max(best)) and sum(cost(a.flow, steps[k]) for k, a in arcs.items()) == pytest.approx(best[sent])


def test_plan():
    shares = mixing.plan({("a",): 100, ("b",): 10, ("a", "b"): 20}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.0, 3)}, 100)
    got = {"a": 0, "b": 0}
    tokens = {("a",): 100, ("b",): 10, ("a", "b"): 20}
    for (p, s), x in shares.items():
        got[s] += x.passes * tokens[p] + x.rest
    assert got == {"a": 50, "b": 50}
    assert mixing.plan({}, {}, 10) == {}


def test_spread_stays_in_proportion_far_beyond_the_quotas():
    shares = mixing.plan({("a",): 10_000_000, ("b",): 10_000_000, ("c",): 10}, {"a": (0.04, 3), "b": (0.01, 3), "c": (0.95, 1)}, 1_000_000)
    got = {s: x.passes * 10_000_000 + x.rest for (p, s), x in shares.items() if s != "c"}
    assert 3.8 < got["a"] / got["b"] < 4.2 and sum(got.values()) == 1_000_000 - 10


def test_more_patterns_than_the_network_holds(spark):
    rows = [(i, 1 + i % 7, [f"s{i % 9}", f"s{i * 5 % 9}", f"s{i * 7 % 9}"]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, sources array<string>")
    targets = spark.createDataFrame([(f"s{i}", 1 / 9, 2) for i in range(9)], "source string, target_share double, max_repeats int")
    whole, narrow = (mixing.shares(mixing.mix(df, targets, max_patterns=n), targets).collect() for n in (512, 4))
    for got in (whole, narrow):
        assert all(abs(r.actual_share - 1 / 9) < 0.02 for r in got), got


def frame(spark, n=2000):
    r = random.Random(4)
    rows = [(i, r.randint(1, 90), [r.choice("aaaab")] if i % 10 else ["a", "b"]) for i in range(n)] + [(n, 50, []), (n + 1, 0, ["a"]), (n + 2, 5, None), (n + 3, 7, ["zzz"]), (n + 4, 9, [None, "c"])]
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, sources array<string>")


def test_mix(spark):
    df = frame(spark)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2), ("c", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets).collect()
    size = df.selectExpr("sum(n_tokens)").first()[0]
    got = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in "abc"}
    assert got["c"] == 27  # one record, three times at most
    b = sum(r.n_tokens for r in df.collect() if r.sources and "b" in r.sources)
    assert got["b"] == min(2 * b, got["b"]) and abs(sum(got.values()) - size) < 200
    assert all(1 <= r.copies <= {"a": 1, "b": 2, "c": 3}[r.source] for r in rows)
    again = mixing.mix(df, targets).collect()
    assert sorted(again) == sorted(rows) and sorted(mixing.mix(df, targets, seed=5).collect()) != sorted(rows)
    report = {r.source: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert report["c"].most_copies == 3 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    none = mixing.mix(frame(spark).limit(0), targets)
    assert none.count() == 0 and mixing.shares(none, targets).first().actual_share == 0.0
    assert mixing.mix(frame(spark), targets.limit(0)).count() == 0
