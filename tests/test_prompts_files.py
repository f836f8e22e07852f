import pytest
from polyquill.dims import COUNTRIES, countries, provider
from polyquill.operators import models, prompts
from polyquill.sources import files
from polyquill.streaming.latest import first_deliveries, keep_last_table, read_last
from pyspark.sql import functions as F


def test_inference_prompts(spark):
    runs = spark.createDataFrame([("m", "Iran", "English", "inst-4"), ("m", "Iran", "Persian", "inst-4"), ("m", "UK", "English", "inst-4")], "model string, country string, language string, prompt_no string")
    q = spark.createDataFrame([("q1", "Iran", "In your country?", "fa?"), ("q1", "UK", "In your country?", "In your country?")], "id string, country string, question string, translation string")
    p = spark.createDataFrame([(c, o, "inst-4", t, "T {q}") for c in ("Iran", "UK") for o, t in ((0, "E {q} {q}"), (1, "later {q}"))], "country string, prompt_ord int, id string, english string, translation string")
    got = {(r.country, r.language): r.prompt for r in prompts.inference(runs, q, countries(spark), p).collect()}
    assert got == {("Iran", "English"): "E In Iran? In Iran?", ("Iran", "Persian"): "T fa?", ("UK", "English"): "E In your country? In your country?"}
    done = spark.createDataFrame([("m", "Iran", "Persian", "inst-4", "q1")], "model string, country string, language string, prompt_no string, id string")
    assert prompts.inference(runs, q, countries(spark), p, done).count() == 2


def test_small_helpers(spark):
    assert len(COUNTRIES) == 16 == countries(spark).count()
    df = spark.createDataFrame([("gpt-4",), ("x-gemini-claude",), ("own",), (None,)], "m string")
    assert [r[0] for r in df.select(provider(F.col("m"))).collect()] == ["azure", "gemini", "local", None]
    with pytest.raises(ValueError, match="as many"):
        prompts.pairs(["a"], [])
    df = spark.createDataFrame([("South_Korea",), ("US",)], "c string")
    assert [r[0] for r in df.select(prompts.name_country_always(F.lit("in your country"), F.col("c"))).collect()] == ["in South Korea", "in the US"]


def test_templates(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"prompt_input": "I {instruction} ({input})\\nR:", "prompt_no_input": "I {instruction}\\nR:", "response_split": "R:"}')
    t = files.read_template(str(tmp_path / "t.json"))
    df = spark.createDataFrame([("do", "x", "l"), ("do", "", None), ("do", None, None)], "i string, g string, l string")
    got = [r[0] for r in df.select(prompts.fill_template(t, F.col("i"), F.col("g"), F.col("l"))).collect()]
    assert got == ["I do (x)\nR:l", "I do\nR:", "I do\nR:"]
    out = spark.createDataFrame([("I do\nR: yes ",), ("nothing",)], "o string")
    assert [r[0] for r in out.select(prompts.template_response(t, F.col("o"))).collect()] == ["yes", None]


def test_calls(spark):
    def make():
        def ask(model, prompt):
            if prompt == "bad":
                raise OSError
            return f"{model}:{prompt}"

        return ask

    df = spark.createDataFrame([("m", "a"), ("m", "bad")], "model string, prompt string")
    assert {r.prompt: r.response for r in models.call_models(df, make, attempts=2, pause=0).collect()} == {"a": "m:a", "bad": None}


def test_files(spark, tmp_path):
    (tmp_path / "Iran_prompts.csv").write_text('id,English,Translation,Extra\r\ninst-4,"say ""hi""\n{q}",T,x\r\n', newline="")
    p = files.read_prompts(spark, str(tmp_path / "*_prompts.csv")).first()
    assert (p.country, p.english, p.translation) == ("Iran", 'say "hi"\n{q}', "T")
    (tmp_path / "m-1-South_Korea_Korean_inst-4_result.csv").write_text('ID,response\nq1,None\nq2,"a, b"\n')
    r = {x.ID: x for x in files.read_responses(spark, str(tmp_path / "*_result.csv")).collect()}
    assert (r["q2"].model, r["q2"].country, r["q2"].language, r["q2"].file_prompt_no) == ("m-1", "South_Korea", "Korean", "inst-4") and r["q1"].response is None
    (tmp_path / "UK_data.json").write_text('{"q1": {"question": "x", "en_question": "y", "annotations": [{"answers": ["a"], "en_answers": ["b"], "count": 2}], "idks": {"no-answer": 1}}}')
    a = files.read_annotations(spark, str(tmp_path / "UK_data.json")).first()
    assert a.country == "UK" and a.annotations[0]["count"] == 2 and a.idks == {"no-answer": 1}
    (tmp_path / "UK_questions.csv").write_text("ID,Question\nq1,What?\n")
    assert files.read_questions(spark, str(tmp_path / "UK_questions.csv")).first().country == "UK"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    files.write_table(spark.range(3).withColumn("k", F.col("id") % 2), str(tmp_path / "t"), ["k"])
    files.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and files.read_csv(spark, str(tmp_path / "c")).count() == 3


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "resp_id bigint, k string, v int, received_at timestamp"
    for i, rows in enumerate([[(1, "a", 1), (1, "a", 1), (2, "b", 5)], [(3, "a", 2)]]):
        spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("received_at", F.lit(f"2024-01-01 0{i}:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    keep_last_table(read(), ["k"], ["resp_id"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    last = read_last(spark, str(tmp_path / "out")).collect()
    assert {(r.k, r.v) for r in last} == {("a", 2), ("b", 5)}
    q = first_deliveries(read()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT resp_id FROM firsts").count() == 3
