from pyspark.sql import functions as F
from datetime import datetime

from polyquill.operators import scoring

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
ANN = "ann_id bigint, country string, qid string, annotations array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>, idks map<string,bigint>, loaded_at timestamp"
RESP = "resp_id bigint, model string, country string, language string, prompt_no string, id string, prompt string, response string, received_at timestamp"
GROUPS = [(["김치"], ["kimchi"], 4), (["밥", None], ["rice", " "], 3)]


def scores(spark, anns, resps):
    a, r = spark.createDataFrame(anns, ANN), spark.createDataFrame(resps, RESP)
    return {(x.model, x.language): (x.questions, x.sem_b, x.sem_w) for x in scoring.soft_match(r, a).collect()}


def resp(i, rid, text, language="English", at=T0, model="m"):
    return (i, model, "South_Korea", language, "inst-4", rid, "Question?\nAnswer:", text, at)


def test_soft_match(spark):
    idks = {"idk": 4, "no-answer": 0, "not-applicable": 0}
    anns = [
        (1, "South_Korea", "q1", GROUPS, idks, T0), (2, "South_Korea", "q2", GROUPS, idks, T0), (3, "South_Korea", "q3", GROUPS, {"no-answer": 2, "not-applicable": 1}, T0),
        (4, "South_Korea", "q4", [], None, T0), (5, "South_Korea", "q5", GROUPS, {"idk": 5}, T0), (6, "South_Korea", "q2", GROUPS, None, T1), (7, "South_Korea", "q6", None, None, T0),
    ]
    # q1 and q2 count; the later response stands; the first group that hits gives the weight.
    got = scores(spark, anns, [resp(1, "q1", "soup"), resp(2, "q1", "Answer: Rice.", at=T1), resp(3, "q3", "rice")])
    assert got == {("m", "English"): (2, 50.0, 37.5)}
    assert scores(spark, anns, [resp(1, "q1", "kimchi and rice"), resp(2, "q2", None)]) == {("m", "English"): (2, 50.0, 50.0)}
    assert scores(spark, anns, [resp(1, "q1", "밥", "Korean"), resp(2, "q1", "밥")]) == {("m", "Korean"): (2, 50.0, 37.5), ("m", "English"): (2, 0.0, 0.0)}
    assert scores(spark, anns, []) == {}


def test_folded_words(spark):
    from polyquill.functions import lemma

    def scored(language, native, english, text):
        a = spark.createDataFrame([(1, "c", "q1", [(["zz"], None, 4), None, (native, english, 2)], None, T0)], ANN)
        r = spark.createDataFrame([(1, "m", "c", language, "p", "q1", "Q?", text, T0)], RESP)
        plain, folded = (scoring.soft_scored(r, a, lemmas).first() for lemmas in (False, True))
        assert scoring.soft_match(r, a, lemmas=True).first().sem_w == 100 * folded.weight_score
        return plain.binary_score, folded.binary_score, folded.weight_score

    assert scored("Spanish", ["caf\u00e9 con leche"], None, "leche con cafe\u0301") == (0, 1, 0.5)
    assert scored("Spanish", ["jamón"], None, "un jamon") == (0, 1, 0.5)
    assert scored("Spanish", ["ma\u00f1ana"], None, "manana") == (0, 0, 0.0)
    assert scored("Chinese", ["米饭"], None, "饭和米") == (0, 1, 0.5)
    assert scored("English", ["米饭"], None, "饭和米") == (0, 0, 0.0)
    assert scored("Azerbaijani", ["İsti çay"], None, "çay, isti") == (0, 1, 0.5)
    # Vowel signs are parts of words.
    assert scored("Assamese", ["ভাত মাছ"], None, "মাছ আৰু ভাত") == (1, 1, 0.5)
    assert scored("Assamese", ["ভাত"], None, "ভূত তা") == (0, 0, 0.0)
    assert scored(None, None, ["café au lait", " ", None], "lait au cafe") == (0, 1, 0.5)
    lemma.register("Test", lambda text: [w.removesuffix("s") for w in text.split()])
    try:
        assert scored("Test", ["cats dog"], None, "dogs and cat") == (0, 1, 0.5)
    finally:
        del lemma._TOKENISERS["Test"]


def test_null_counts(spark):
    anns = [(1, "South_Korea", "q1", [(None, ["a"], None), (["b"], None, 2)], None, T0)]
    assert scores(spark, anns, [resp(1, "q1", "a")]) == {("m", "English"): (1, 100.0, 0.0)}


def test_results_keep_last(spark):
    schema = "model string, country string, language string, prompt_no string, eval_method string, score double"
    old = spark.createDataFrame([("m", "c", "l", None, "MC", 5.0), ("m", "c", "l", "p", "MC", 1.0)], schema)
    new = spark.createDataFrame([("m", "c", "l", None, "MC", 6.0)], schema)
    assert {tuple(r) for r in scoring.merge_results(old, new).collect()} == {("m", "c", "l", None, "MC", 6.0), ("m", "c", "l", "p", "MC", 1.0)}


def test_choice_accuracy(spark):
    df = spark.createDataFrame([("m", "c", "A", "A"), ("m", "c", "B", None), ("m", "c", None, None)], "model string, country string, answer_idx string, final_ans string")
    assert abs(scoring.choice_accuracy(df).first().score - 2 / 3) < 1e-9


def test_running_sums_over_blocks(spark):
    import random

    from polyquill.operators.latest import running

    r = random.Random(1)
    rows = [(r.choice(("hot", "hot", "hot", "b", None)), i * 3, r.randint(0, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int")
    got = {x.i: (x.s, x.n) for x in running(df, ["k"], "i", {"s": F.col("v"), "n": F.lit(1)}, block=40).collect()}
    sums = {}
    for k, i, v in rows:
        sums[k] = (sums.get(k, (0, 0))[0] + v, sums.get(k, (0, 0))[1] + 1)
        assert got[i] == sums[k]
    assert len(got) == 500 and running(df.limit(0), ["k"], "i", {"s": F.col("v")}).count() == 0
