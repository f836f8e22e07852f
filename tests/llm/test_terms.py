import random
from collections import Counter
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from polyquill.llm import terms


def brute(records, most):
    tf, df = Counter(), Counter()
    for r in records:
        seen = set()
        for v in r or ():
            w = v.lower().split() if v else []
            for n in range(most + 1):
                for i in range(len(w) - n + 1) if n else range(min(1, len(w))):
                    k = (" ".join(w[i : i + (n or len(w))]), n)
                    tf[k] += 1
                    seen.add(k)
        df.update(seen)
    return {k: (tf[k], df[k]) for k in tf}


value = st.none() | st.lists(st.sampled_from(["a", "b", "A", "ab", " ", "c\t"]), max_size=7).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(value, max_size=5), max_size=8))
def test_as_brute_force(records):
    assert {(t, n): (o, r) for t, n, o, r in terms.block_counts(records, 3)} == brute(records, 3)


def test_all_lengths():
    records = [["a b c d e", "b c d e"], ["c d e f g h", "x"], None]
    got = {(t, n): (o, c) for t, n, o, c in terms.block_counts(records, None)}
    assert got == brute(records, 6) and got["c d e", 3] == (3, 2) and got["b c d e", 4] == (2, 1)
    assert list(terms.block_counts([], None)) == []


def test_ngrams_query(spark, tmp_path):
    from polyquill.llm.queries import p1_ngrams

    row = (1, "c", "q", [([], ["one two three four five"], 1)], datetime(2024, 1, 1))
    spark.createDataFrame([row], "ann_id bigint, country string, qid string, annotations array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>, loaded_at timestamp").write.parquet(f"{tmp_path}/annotations.parquet")
    assert Counter(r.n for r in p1_ngrams(spark, str(tmp_path)).collect()) == {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}


def test_long_value():
    r = random.Random(1)
    records = [[" ".join(r.choice("ab") for _ in range(3000))], ["a b a"]]
    got = {(t, n): (o, c) for t, n, o, c in terms.block_counts(records, 2)}
    assert got == brute(records, 2)


def test_blocks_add_up(spark):
    rows = [([f"v{i % 7}", "x y", "x y"],) for i in range(100)]
    df = spark.createDataFrame(rows, "vals array<string>").repartition(5)
    got = {(r.term, r.n): (r.occurrences, r.records) for r in terms.counts(df, "vals", 2).collect()}
    assert got == brute([r[0] for r in rows], 2)
    assert terms.counts(df.limit(0), "vals").count() == 0


def test_records(spark):
    t = [datetime(2024, 1, d) for d in (1, 2)]
    g = lambda *en: [([], list(en), 1), None, (None, None, None)]
    rows = [(1, "c", "q", g("old"), t[0]), (2, "c", "q", g("New ", None, " "), t[1]), (2, "c", "q", g("New ", None, " "), t[1]), (3, "c", "p", None, t[0]), (4, None, None, [], None)]
    df = spark.createDataFrame(rows, "ann_id bigint, country string, qid string, annotations array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>, loaded_at timestamp")
    records = terms.annotation_records(df)
    assert records.count() == 3
    found = terms.counts(records, "values")
    total = records.selectExpr("count(1) AS n_records")
    assert [(r.term, r.records, r.mark) for r in terms.mark_terms(found, total).collect()] == [("new", 1, "rare")]
    assert [r.mark for r in terms.mark_terms(found, total, rare_records=1).collect()] == ["common"]
    clash = df.selectExpr("*", "1 AS values", "2 AS term", "3 AS _last", "4 AS n_records")
    assert terms.counts(terms.annotation_records(clash), "values").count() == 1
