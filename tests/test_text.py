import pytest
from polyquill.functions import lemma
from polyquill.functions import text as T
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "time", "date", "number"), [
    ("12:30", True, False, False), ("9:30", False, False, False), ("1/31", False, True, False), ("13/45", False, True, False), ("2024/1/1", False, False, False),
    ("10", False, False, True), (" 1e3 ", False, False, True), ("1d", False, False, False), ("rice", False, False, False), ("", False, False, False),
])
def test_types(spark, text, time, date, number):
    assert one(spark, F.array(T.is_time(F.col("a")), T.is_date(F.col("a")), T.is_number(F.col("a"))), a=text) == [time, date, number]


@pytest.mark.parametrize(("a", "b", "differ"), [
    ("10", "10.0", False), ("10", "100", True), ("nan", "nan", True), ("rice", "fried rice", False), ("rice/soup", "fish soup", False), ("rice", "soup", True), ("a  b", "b c", False), ("12:30", "12:30", False),
])
def test_no_common_word(spark, a, b, differ):
    assert one(spark, T.no_common_word(F.col("a"), F.col("b")), a=a, b=b) is differ


@pytest.mark.parametrize(("response", "prompt", "out"), [
    ("Answer: Rice.", "Question?\nAnswer:", "rice"), ("答案：米饭。", "问题\n答案:", "答案:米饭"), ("Note: Rice.", "Question?", "note: rice"), ("Answer: Answer: x", "Answer:", "x"),
    ("Q?\nAnswer:Answer: tea", "Q?\nAnswer:", "tea"), ("Q?\nAnswer:\nAnswer: tea", "Q?\nAnswer:", "answer: tea"), ("", "p", ""), ("...", "p", ""), (None, "p", None), ("x", None, None),
])
def test_normal_response(spark, response, prompt, out):
    assert one(spark, T.normal_response(F.col("r"), F.col("p")), r=response, p=prompt) == out


@pytest.mark.parametrize(("answer", "response", "hit"), [
    ("rice", "kimchi and rice", True), ("Rice", "rice", True), ("old-fashioned tea", "the old fashioned tea", True), ("tea green", "green tea", True), ("  ", "anything", False), ("...", "...", False), ("soup", "rice", False),
])
def test_matches(spark, answer, response, hit):
    assert one(spark, T.matches(F.col("a"), F.col("r")), a=answer, r=response) is hit


@pytest.mark.parametrize(("text", "out"), [
    ('{"answer_choice": "B"}', {"answer_choice": "B"}), ('Sure:\n```json\n{"answer_choice":"B",}\n```', {"answer_choice": "B"}), ("no braces", None), ("{broken", None), ("{not: json}", None), ("{}", None), (None, None),
])
def test_json_object(spark, text, out):
    assert one(spark, T.json_object(F.col("t")), t=text) == out


def test_json_list(spark):
    assert one(spark, T.json_list(F.col("t")), t='x [ {"a": "1"}, {"a": "2"} ] y') == [{"a": "1"}, {"a": "2"}]
    assert one(spark, T.json_list(F.col("t")), t="[1]") is None


@pytest.mark.parametrize(("res", "letter"), [
    ('{"answer_choice":"B"}', "B"), ('{"answer_choice":"kimchi"}', "C"), ('{"answer_choice":"Kimchi"}', '{"answer_choice":"Kimchi"}'), ("The answer is B", "T"), ('{"other":"B"}', '{"other":"B"}'), ("none", "none"), ('{"answer_choice":null}', '{"answer_choice":null}'),
])
def test_choice_letter(spark, res, letter):
    options = F.create_map(F.lit("A"), F.lit("rice"), F.lit("B"), F.lit("tea"), F.lit("C"), F.lit("kimchi"))
    assert one(spark, T.choice_letter(F.col("r"), F.col("p"), options), r=res, p="A. rice\nB. tea\nC. kimchi\n") == letter


def test_between_and_history(spark):
    assert one(spark, T.between(F.col("t"), "<s>", "</s>"), t="a<s>b</s>c") == "b"
    assert one(spark, T.between(F.col("t"), "<s>", "</s>"), t="a<s>bc") == "bc"
    df = spark.sql("SELECT array(struct('user' AS role, 'x' AS content)) AS h, array(struct('' AS role, 'x' AS content)) AS g")
    assert tuple(df.select(T.valid_history(F.col("h")), T.valid_history(F.col("g"))).first()) == (True, False)


def test_flag(spark):
    df = spark.createDataFrame([("Yes",), ("f",), (" 0 ",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(T.flag(F.col("t"))).collect()] == [True, False, False, None, None]


def test_strip_long_runs(spark):
    df = spark.range(200).select(F.concat(F.lit("\u00a0\t a"), F.lit(" " * 50000), F.lit("b\u3000\n")).alias("t"))
    assert df.where(F.length(T.strip(F.col("t"))) == 50002).count() == 200


def test_lemmas(spark):
    assert lemma.fold("Café") == "cafe" and lemma.fold("ñ") == "ñ"
    assert lemma.lemmas("你好", "Chinese") == ["你", "好"]
    assert lemma.lemmas("İki-üç 'x'", "Azerbaijani") == ["iki-üç", "x"] or lemma.lemmas("İki", "Azerbaijani") == ["iki"]
    df = spark.createDataFrame([("A b.", "English"), (None, None), ("", "Greek")], "t string, l string")
    assert [r[0] for r in df.select(lemma.lemmas_udf()(F.col("t"), F.col("l"))).collect()] == [["a", "b"], None, []]


def test_letters_step_by_step(spark):
    """Every form reads as by the parser, in steps or not."""
    said = ['{"answer_choice":"B"}', 'So: {"answer_choice": "tea",}', '```json {"answer_choice": "rice",}```', '{"answer_choice":""}', '{"answer_choice":null}', '{"answer_choice":1.50}', '{"choice":"A"}', '{"choice":"A","answer_choice":"B"}']
    said += ['{"answer_choice":"a\\u0042"}', '{"answer\\u005fchoice":"B"}', "{B}", "It is C.", "none", "", None, '{\n"answer_choice": "Z"}', '{"answer_choice":"no\ntea"}', '{"x":"answer_choice"} B', '{"answer_choice":"B"} {"answer_choice":"A"}', '{}{"answer_choice":"B"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, full_res string").withColumn("prompt", F.lit("A. tea\nB. rice\nC. 1.50\n")).withColumn("choices", F.create_map(*(F.lit(x) for x in ("A", "tea", "B", "rice", "C", "1.50"))))
    got = T.with_choice_letter(df).withColumn("parsed", T.choice_letter(F.col("full_res"), F.col("prompt"), F.col("choices"))).orderBy("i").collect()
    assert [r.final_ans for r in got] == [r.parsed for r in got]
    assert [r.final_ans for r in got][:3] == ["B", "A", "B"]
