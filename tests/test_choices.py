import itertools
import random

from polyquill.dims import countries
from polyquill.operators import choices
from pyspark.sql import functions as F


def differ(a, b):
    def num(x):
        try:
            return float(x)
        except ValueError:
            return None

    if num(a) is not None and num(b) is not None:
        return num(a) != num(b)
    if a in b or b in a:
        return False
    return not set(a.replace("/", " ").split()) & set(b.replace("/", " ").split())


def brute(reps, order, judged=frozenset()):
    """Greedy choice row by row."""
    out = {}
    for qid in {r[1] for r in reps}:
        rows = [r for r in reps if r[1] == qid]
        cands = sorted((r for r in rows if r[4] >= 2), key=lambda r: (-r[4], order[r[0]], r[5]))
        for country in {r[0] for r in rows}:
            own = [r[3] for r in rows if r[0] == country]
            chosen, blocked = {}, set()
            for c in cands:
                if c[0] == country or c[0] in chosen or c[3] in blocked:
                    continue
                like = lambda x, c=c: not differ(c[3], x) or tuple(sorted((c[3], x))) in judged
                if any(map(like, own)) or any(map(like, chosen.values())):
                    blocked.add(c[3])
                else:
                    chosen[c[0]] = c[3]
            out[country, qid] = list(chosen.items())
    return out


def test_greedy_as_brute_force(spark):
    r = random.Random(5)
    words = ["rice", "soup", "tea", "fish soup", "10", "10.0", "100", "bread", "plum jam", "rye bread", "kite", "rope"]
    names = [c.country for c in countries(spark).collect()]
    reps = []
    for q in range(12):
        for c in r.sample(names, 7):
            for pos, a in enumerate(r.sample(words, 3)):
                reps.append((c, f"q{q}", "What?", a, r.randint(0, 5), pos))
    df = spark.createDataFrame(reps, "country string, qid string, question string, answer string, votes bigint, pos int")
    order = {c: i for i, c in enumerate(names)}
    got = lambda x: {(a.country, a.qid): [(c.country, c.answer) for c in a.choices] for a in x.collect()}
    assert got(choices.distractors(df, countries(spark))) == brute(reps, order)
    judged = spark.createDataFrame([(f"q{q}", "rice", "kite", True) for q in range(12)], "qid string, a string, b string, is_similar boolean")
    assert got(choices.distractors(df, countries(spark), judged, unjudged=False)) == brute(reps, order, {("kite", "rice")})


def test_typed_question(spark):
    rows = [("UK", "q", "When (HH:MM)?", "12:30", 3, 0), ("UK", "q", "When (HH:MM)?", "noon", 5, 1), ("US", "q", "When (HH:MM)?", "11:00", 2, 0), ("US", "q", "When (HH:MM)?", "late", 9, 1)]
    df = spark.createDataFrame(rows, "country string, qid string, question string, answer string, votes bigint, pos int")
    got = {r.country: r for r in choices.distractors(df, countries(spark)).collect()}
    assert got["UK"].answers == [] and [c.answer for c in got["UK"].choices] == ["11:00"]


def test_combinations(spark):
    for n, m in itertools.product(range(6), range(4)):
        items = F.array(*(F.lit(str(i)) for i in range(n))) if n else F.array().cast("array<string>")
        got = spark.range(1).select(choices.combinations(items, F.lit(m)).alias("c")).first().c
        assert [tuple(x) for x in got] == list(itertools.combinations([str(i) for i in range(n)], m)), (n, m)


def test_assemble(spark):
    rows = [("US", "q", "Who in your country?", ["z"], [("UK", "a"), ("Spain", "b"), ("Iran", "c"), ("Mexico", "d")]), ("UK", "q", "Who in your country?", ["y"], [("US", "e"), ("Spain", "f"), ("Iran", "g")])]
    df = spark.createDataFrame(rows, "country string, qid string, question string, answers array<string>, choices array<struct<country:string,answer:string>>")
    got = choices.assemble(df, countries(spark), all_countries=False).orderBy(F.length("MCQID"), "MCQID").collect()
    assert [r.MCQID for r in got] == [f"q_{i}" for i in range(5)] and got[0].country == "UK"
    assert got[1].choices == {"A": "a", "B": "b", "C": "c", "D": "z"} and got[1].answer_idx == "D" and got[1].choice_countries["D"] == "US"
    assert got[1].prompt.startswith("Who in the US? Without any explanation") and got[1].prompt.endswith("D. z\n\nAnswer:")
    assert choices.assemble(df, countries(spark)).count() == 0  # the other countries have none
    dummies = spark.createDataFrame([("q", x) for x in ("k", "l", "m")], "qid string, option string")
    assert choices.assemble(df, countries(spark), dummies).count() == 2  # three dummies each


def test_representative(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    schema = "ann_id bigint, country string, qid string, en_question string, annotations array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>, idks map<string,bigint>, loaded_at timestamp"
    rows = [(1, "UK", "q", "x", [([], ["a", "b"], 3), ([], [], 9), ([], ["c"], None), ([], ["a"], 1), ([], [" "], 4), (None, None, 2)], None, t)]
    got = {(r.answer, r.votes, r.pos) for r in choices.representative(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", 1, 0), ("c", 0, 2)}


def test_judgements(spark):
    rows = [("UK", "q", "x", "rice", 3, 0), ("US", "q", "x", "kite", 3, 0), ("US", "q", "x", "oats", 2, 1), ("Iran", "q", "x", "7", 2, 0)]
    reps = spark.createDataFrame(rows, "country string, qid string, question string, answer string, votes bigint, pos int")
    judged = spark.createDataFrame([("q", "rice", "kite", False), ("q", "oats", "rice", True)], "qid string, a string, b string, is_similar boolean")
    uk = lambda **k: [c.answer for c in choices.distractors(reps, countries(spark), judged, **k).where("country = 'UK'").first().choices]
    assert uk() == ["kite"]  # 7 against rice was not judged: similar
    assert uk(unjudged=False) == ["kite", "7"]
    typed = spark.createDataFrame([("UK", "q", "MM/DD?", "1/31", 3, 0), ("US", "q", "MM/DD?", "2/28", 3, 0)], "country string, qid string, question string, answer string, votes bigint, pos int")
    got = choices.distractors(typed, countries(spark), judged).where("country = 'UK'").first()
    assert [c.answer for c in got.choices] == ["2/28"]  # two dates that differ need no judge


def test_fillers(spark):
    reps = spark.createDataFrame([("UK", "q", "rice")], "country string, qid string, answer string")
    options = spark.createDataFrame([("q", "rice"), ("q", "Rice"), ("q", "Oak"), ("q", "oak"), ("q", None), ("q", " "), ("z", "rice")], "qid string, option string")
    assert {tuple(r) for r in choices.fillers(options, reps).collect()} == {("q", "rice"), ("q", "oak"), ("z", "rice")}  # as written, "Rice" is no answer


def test_choices_file_round_trip(spark, tmp_path):
    from pyspark.sql import Observation

    from polyquill.sources import files

    rows = [("US", "q", "Who, in \"your country\"?", ["z"], [("UK", "a"), ("Spain", 'b "x"'), ("Iran", "c")])]
    df = spark.createDataFrame(rows, "country string, qid string, question string, answers array<string>, choices array<struct<country:string,answer:string>>")
    mc = choices.assemble(df, countries(spark), all_countries=False)
    files.write_csv(choices.encoded(mc), str(tmp_path / "mc"))
    back = files.read_choices(spark, str(tmp_path / "mc"))
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in mc.collect()] and back.count() == 1
    watch = Observation("written")
    files.write_table(mc, str(tmp_path / "t"), watch=watch)
    assert watch.get["rows"] == 1


def test_letters_as_questions(spark):
    """Counts, least numbers and greatest choices by letter, without the questions
    themselves: as from them, for texts that JSON escapes and orders otherwise too."""
    names = ["UK", "Spain", "Iran", "Mexico", "China", "Greece", "Assam"]
    texts = ["a", 'a"', "a!", "a b", "\u00e9", "B\\", "z"]
    rows = [(c, q, "Who?", [f"own{i}", "a!x"], [(n, t) for n, t in zip(names, texts) if n != c]) for q in ("q", "r") for i, c in enumerate(["US", "UK", "Iran"])]
    df = spark.createDataFrame(rows, "country string, qid string, question string, answers array<string>, choices array<struct<country:string,answer:string>>")
    options = spark.createDataFrame([(q, x) for q in ("q", "r") for x in ("k", "l", "m")], "qid string, option string")
    for given in ((df, countries(spark), None, False), (df, countries(spark), options, True)):
        mc = choices.assemble(*given).groupBy("ID", "country", "answer_idx").agg(F.count(F.lit(1)).alias("n"), F.min("MCQID").alias("first_id"), F.max(F.to_json("choices")).alias("last_choices"))
        want = sorted(map(tuple, mc.collect()))
        assert want and sorted(map(tuple, choices.letters(*given).collect())) == want
