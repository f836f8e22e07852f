"""Queries of prompts, scores and multiple choice over the domain tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyquill import dims
from polyquill.functions import lemma
from polyquill.functions import text as T
from polyquill.operators import choices, prompts, scoring
from polyquill.operators.latest import keep_first, keep_last, missing_from, running
from polyquill.session import table

Query = Callable[[SparkSession, str], DataFrame]
RUN = scoring.RUN
#: Limits under which the generated annotations leave some questions over.
_WIDE = {"most_na": 4, "most_idks": 7, "least_votes": 1}
TEMPLATE = "Answer briefly.\n\nQuestion: {q}\nAnswer:"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(table(spark, d, "questions").select("id", "country", "topic", "source", "question", "translation", "updated_at"), ["id", "country"], ["updated_at", "question"])


def question_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last correction of every question, with a clean topic."""
    q = _questions(spark, d)
    return q.select("id", "country", F.lower(T.strip(F.col("topic"))).alias("topic"), "source", T.strip(F.col("question")).alias("question"))


def question_first(spark: SparkSession, d: str) -> DataFrame:
    """Of an id given twice the first stands."""
    q = keep_first(table(spark, d, "questions").select("id", "country", "question", "updated_at"), ["id", "country"], ["updated_at", "question"])
    return q.select("id", "country", "question")


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """The rendered prompt of every question in both languages."""
    countries = table(spark, d, "countries").select("country", F.col("language").alias("native"))
    q = _questions(spark, d).join(F.broadcast(countries), "country")
    legs = q.select("*", F.explode(F.array_distinct(F.array("native", F.lit("English")))).alias("language"))
    text = prompts.question_column(F.col("language"), F.col("native"), F.col("question"), F.col("translation"))
    asked = prompts.name_country(text, F.col("country"), F.col("language"), F.col("native"))
    return legs.select("id", "country", "language", prompts.render(F.lit(TEMPLATE), asked).alias("prompt")).where("prompt is not null")


def _dimensions(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The models and prompt ids that occur, from one scan and two sets."""
    sets = responses.agg(F.collect_set("model").alias("model"), F.collect_set("prompt_no").alias("prompt_no"))
    return sets.select(F.explode("model").alias("model")), sets.select(F.explode("prompt_no").alias("prompt_no"))


def prompt_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every run of models, countries, prompts and language legs."""
    models, ids = _dimensions(table(spark, d, "model_inference_results"))
    return prompts.matrix(models, table(spark, d, "countries"), ids)


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Questions that no model has answered yet."""
    done = table(spark, d, "model_inference_results").select("id", "country")
    return missing_from(table(spark, d, "questions").select("id", "country").distinct(), done, ["id", "country"])


def question_semi(spark: SparkSession, d: str) -> DataFrame:
    """Annotated questions that were asked."""
    asked = table(spark, d, "model_inference_results").select(F.col("id").alias("qid"), "country").distinct()
    return table(spark, d, "annotations").select("country", "qid").distinct().join(asked, ["country", "qid"], "left_semi")


def provider_route(spark: SparkSession, d: str) -> DataFrame:
    """M1: provider of every model."""
    return table(spark, d, "model_inference_results").groupBy("model").agg(F.count(F.lit(1)).alias("n")).select("model", dims.provider(F.col("model")).alias("provider"), "n")


def last_response(spark: SparkSession, d: str) -> DataFrame:
    """The last response of every run and question."""
    return scoring.last_responses(table(spark, d, "model_inference_results")).select(*RUN, "id", "resp_id", "response")


def response_normal(spark: SparkSession, d: str) -> DataFrame:
    """Last responses as they are matched."""
    r = scoring.last_responses(table(spark, d, "model_inference_results"))
    return r.select("resp_id", T.normal_response(F.col("response"), F.col("prompt")).alias("normal"))


def annotation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the latest annotations, with their size and votes."""
    ann = scoring.latest_annotations(table(spark, d, "annotations"), "annotations")
    g = ann.select("country", "qid", F.posexplode("annotations").alias("grp", "g"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return g.select("country", "qid", F.col("grp").cast("bigint").alias("grp"), size(F.col("g.answers")).alias("n_answers"), size(F.col("g.en_answers")).alias("n_en"), F.col("g.count").alias("votes"))


def valid_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions that count for scores."""
    ann = scoring.latest_annotations(table(spark, d, "annotations"), "annotations", "idks")
    return ann.where(scoring.is_valid(F.col("annotations"), F.col("idks"))).select("country", "qid")


def idk_sum(spark: SparkSession, d: str) -> DataFrame:
    """All idk votes of a question."""
    total = F.aggregate(F.coalesce(F.map_values("idks"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return scoring.latest_annotations(table(spark, d, "annotations"), "idks").select("country", "qid", total.alias("idk_votes"))


def question_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions fit for multiple choice."""
    return choices.question_filter(table(spark, d, "annotations"))


def question_filter_wide(spark: SparkSession, d: str) -> DataFrame:
    """P9 with wider limits, which leave questions of 16 countries over."""
    return choices.question_filter(table(spark, d, "annotations"), **_WIDE)


def representative(spark: SparkSession, d: str) -> DataFrame:
    """P10: representative answers with their votes."""
    r = choices.representative(table(spark, d, "annotations"))
    return r.select("country", "qid", "answer", F.col("votes").cast("bigint").alias("votes"), F.col("pos").cast("bigint").alias("pos"))


def max_vote_ties(spark: SparkSession, d: str) -> DataFrame:
    """A4: top answers with ties."""
    return choices.top_answers(choices.representative(table(spark, d, "annotations"))).select("country", "qid", "answer", "votes")


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    """A2, O3: votes by the question's most votes."""
    r = choices.representative(table(spark, d, "annotations"))
    most = r.groupBy("country", "qid").agg(F.max("votes").alias("most"))
    return r.join(most, ["country", "qid"]).select("country", "qid", "answer", F.round(F.try_divide("votes", "most"), 6).alias("weight"))


def soft_match(spark: SparkSession, d: str) -> DataFrame:
    """L2, J1, A1, A2, F12 (a, d): both soft scores of every run."""
    return scoring.soft_match(table(spark, d, "model_inference_results"), table(spark, d, "annotations"))


def soft_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored responses; the first group that hits gives the weight."""
    s = scoring.soft_scored(table(spark, d, "model_inference_results"), table(spark, d, "annotations"))
    return s.select("resp_id", "id", "country", "binary_score", F.round("weight_score", 6).alias("weight_score"))


def soft_match_lemma(spark: SparkSession, d: str) -> DataFrame:
    """both soft scores of every run, by folded words of the language."""
    return scoring.soft_match(table(spark, d, "model_inference_results"), table(spark, d, "annotations"), lemmas=True)


def soft_scored_lemma(spark: SparkSession, d: str) -> DataFrame:
    """responses scored by folded words of the language."""
    s = scoring.soft_scored(table(spark, d, "model_inference_results"), table(spark, d, "annotations"), lemmas=True)
    return s.select("resp_id", "id", "country", "binary_score", F.round("weight_score", 6).alias("weight_score"))


def hard_match(spark: SparkSession, d: str) -> DataFrame:
    """A3: scores by equality."""
    return scoring.hard_match(table(spark, d, "model_inference_results"), table(spark, d, "annotations"))


def _results(spark: SparkSession, d: str, second: DataFrame) -> DataFrame:
    first = hard_match(spark, d).select(*RUN, F.col("em_b").alias("sem_b"), F.col("em_w").alias("sem_w"))
    return scoring.merge_results(scoring.as_results(first), scoring.as_results(second))


def results_table(spark: SparkSession, d: str) -> DataFrame:
    """Scores by method; those of the second evaluation, by words,
    stand over those of the first, by equality."""
    return _results(spark, d, soft_match(spark, d))


def results_table_lemma(spark: SparkSession, d: str) -> DataFrame:
    """results_table of the scores by folded words."""
    return _results(spark, d, soft_match_lemma(spark, d))


def cross_group(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of countries with the same representative answer to a question."""
    r = choices.representative(table(spark, d, "annotations")).select("country", "qid", "answer")
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.answer") == F.col("b.answer")) & (F.col("a.country") < F.col("b.country"))).select(F.col("a.qid").alias("qid"), F.col("a.answer").alias("answer"), F.col("a.country").alias("country_a"), F.col("b.country").alias("country_b"))


def typed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Format of every English answer."""
    g = table(spark, d, "annotations").select(F.explode("annotations").alias("g")).select(F.explode("g.en_answers").alias("answer")).where("answer is not null").distinct()
    a = T.strip(F.col("answer"))
    return g.select("answer", T.is_time(a).alias("is_time"), T.is_date(a).alias("is_date"), T.is_number(a).alias("is_number"))


def no_common_word(spark: SparkSession, d: str) -> DataFrame:
    """Whether the answers of two countries to a question differ."""
    r = choices.representative(table(spark, d, "annotations")).select("country", "qid", "answer", "pos").where("pos = 0")
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.country") < F.col("b.country")))
    return pairs.select(F.col("a.qid").alias("qid"), F.col("a.country").alias("country_a"), F.col("b.country").alias("country_b"), T.no_common_word(F.col("a.answer"), F.col("b.answer")).alias("differ"))


def token_subset(spark: SparkSession, d: str) -> DataFrame:
    """Representative answers whose words all stand in their question."""
    r = choices.representative(table(spark, d, "annotations"))
    return r.where((F.size(T.tokens(F.col("answer"))) > 0) & (F.size(F.array_except(T.tokens(F.col("answer")), T.tokens(F.col("question")))) == 0)).select("country", "qid", "answer")


def answer_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct answers of a question over all countries."""
    r = choices.representative(table(spark, d, "annotations"))
    return r.groupBy("qid").agg(F.countDistinct("answer").alias("answers"), F.countDistinct("country").alias("countries"))


def distractor_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of every other country its first answer with enough votes
    that is none of the own ones."""
    r = choices.representative(table(spark, d, "annotations")).select("country", "qid", "answer", "votes", "pos")
    other = r.where(F.col("votes") >= choices.MIN_VOTES)
    own = r.select("country", "qid").distinct()
    pairs = own.alias("o").join(other.alias("c"), (F.col("o.qid") == F.col("c.qid")) & (F.col("o.country") != F.col("c.country"))).select(F.col("o.qid").alias("qid"), F.col("o.country").alias("country"), F.col("c.country").alias("other_country"), F.col("c.answer").alias("answer"), F.col("c.votes").alias("votes"), F.col("c.pos").alias("pos"))
    left = pairs.join(r.select("country", "qid", "answer"), ["country", "qid", "answer"], "left_anti")
    first = Window.partitionBy("country", "qid", "other_country").orderBy(F.desc("votes"), "pos")
    return left.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("country", "qid", "other_country", "answer", "votes")


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return choices.distractors(choices.representative(table(spark, d, "annotations")), table(spark, d, "countries"))


def distractor_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Greedy distractors of every question and country, in order."""
    return _one_by_one(_chosen(spark, d))


def _one_by_one(chosen: DataFrame) -> DataFrame:
    # The outer form: the inner one filters by the list's size first, and makes the fold twice.
    c = chosen.select("country", "qid", F.posexplode_outer("choices").alias("n", "c")).where("c is not null")
    return c.select("country", "qid", F.col("n").cast("bigint").alias("n"), F.col("c.country").alias("other_country"), F.col("c.answer").alias("answer"))


def distractor_judged(spark: SparkSession, d: str) -> DataFrame:
    """Distractors where pairs of representative answers that begin
    with the same letter were judged similar, others different; here a stand-in
    for a judge's table, by question."""
    reps = choices.representative(table(spark, d, "annotations"))
    each = reps.select("qid", "answer").distinct()
    a, b = each.select("qid", F.col("answer").alias("a")), each.select("qid", F.col("answer").alias("b"))
    judged = a.join(b, "qid").where("a < b").withColumn("is_similar", F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return _one_by_one(choices.distractors(reps, table(spark, d, "countries"), judged))


def min_choices(spark: SparkSession, d: str) -> DataFrame:
    """The fewest distractors of a question over all countries, those
    without it counting as none."""
    c = _chosen(spark, d).where("country is not null").groupBy("qid").agg(F.min(F.size("choices")).alias("few"), F.count(F.lit(1)).alias("held"))
    every = table(spark, d, "countries").agg(F.count(F.lit(1)).alias("every"))  # one row
    return c.crossJoin(F.broadcast(every)).select("qid", F.when(F.col("held") < F.col("every"), 0).otherwise(F.col("few")).cast("bigint").alias("least"))


def _options(spark: SparkSession, d: str) -> DataFrame:
    """Filler options by question, a stand-in for a table of them: the regions'
    names, and one answer of every country, which are no fillers."""
    reps = choices.representative(table(spark, d, "annotations"))
    names = F.broadcast(table(spark, d, "region").select(F.col("r_name").alias("option")))  # 5 rows, fixed
    return reps.select("qid").distinct().crossJoin(names).unionByName(reps.where("pos = 0").select("qid", F.col("answer").alias("option")))


def filler_options(spark: SparkSession, d: str) -> DataFrame:
    """Options that may fill up a question."""
    return choices.fillers(_options(spark, d), choices.representative(table(spark, d, "annotations")))


def _mc(spark: SparkSession, d: str) -> DataFrame:
    fit = choices.question_filter(table(spark, d, "annotations"), **_WIDE)
    reps = choices.representative(table(spark, d, "annotations"))
    countries = table(spark, d, "countries")
    return choices.assemble(choices.distractors(reps.join(fit, "qid", "left_semi"), countries), countries, choices.fillers(_options(spark, d), reps))


def mc_questions(spark: SparkSession, d: str) -> DataFrame:
    """The file of multiple-choice questions: a
    country without the question has no choices, fillers make up for what is
    missing. The question filter has the wide limits, as none passes the strict."""
    return choices.encoded(_mc(spark, d))


def mc_given(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice questions by the countries that have them, with
    three distractors each: how many by question, country and letter."""
    fit = choices.question_filter(table(spark, d, "annotations"), **_WIDE)
    reps = choices.representative(table(spark, d, "annotations")).join(fit, "qid", "left_semi")
    return choices.letters(choices.distractors(reps, table(spark, d, "countries")), table(spark, d, "countries"), all_countries=False)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Responses of two models to all multiple-choice questions, a stand-in for
    asking them: as a letter, as a text, in prose, or without an answer."""
    n = F.element_at(F.split("MCQID", "_"), -1).cast("int")
    asked = _mc(spark, d).withColumn("n", n).withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1"))))
    k = F.col("n") + F.length("prompt") + F.when(F.col("model") == "m1", 1).otherwise(0)
    letter = F.char(F.lit(65) + k % 4)
    form = F.col("n") % 5
    said = (
        F.when(form == 0, F.concat(F.lit('{"answer_choice":"'), letter, F.lit('"}'))).when(form == 1, F.concat(F.lit('```json {"answer_choice": "'), F.try_element_at("choices", letter), F.lit('",}```')))
        .when(form == 2, F.concat(F.lit("It is "), letter, F.lit("."))).when(form == 3, F.lit('{"choice":"A"}')).otherwise(letter)
    )
    return asked.withColumn("full_res", said)


def letter_extract(spark: SparkSession, d: str) -> DataFrame:
    """The letter each response to a multiple-choice question picks."""
    return T.with_choice_letter(_answers(spark, d)).select("model", "MCQID", "final_ans")


def mc_score(spark: SparkSession, d: str) -> DataFrame:
    """Share of right letters by model and country."""
    a = T.with_choice_letter(_answers(spark, d))
    return scoring.choice_accuracy(a).select("model", "country", F.round("score", 6).alias("score"))


def running_mc_score(spark: SparkSession, d: str) -> DataFrame:
    """The share of right letters so far, by model and question, in the
    order of the questions' numbers."""
    a = T.with_choice_letter(_answers(spark, d)).withColumn("right", (F.col("final_ans") == F.col("answer_idx")).cast("int"))
    w = Window.partitionBy("model", "ID").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.select("model", "MCQID", F.round(F.avg(F.coalesce("right", F.lit(0))).over(w), 6).alias("score"))


def resume_choices(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose last country is still missing."""
    held = scoring.latest_annotations(table(spark, d, "annotations"), "annotations").where(F.size("annotations") > 0)
    return choices.unfinished(table(spark, d, "annotations").select("qid"), held, table(spark, d, "countries"))


def nested_answer(spark: SparkSession, d: str) -> DataFrame:
    """the widest JSON object in every response."""
    r = table(spark, d, "model_inference_results").select("resp_id", "response").distinct()
    return r.select("resp_id", T.nested_json(F.col("response")).alias("body")).where("body is not null")


_SHEETS = (("inst-4", "Reply in one word.\n{q}\nReply:", "> {q}\n>"), ("pers-3", "You are a local guide. {q}", "* {q} / {q}"), ("inst-4", "second {q}", "second {q}"))


def inference_rows(spark: SparkSession, d: str) -> DataFrame:
    """The prompts still to send, of all runs, from two
    prompts a country, one of them given twice (the first stands)."""
    countries = table(spark, d, "countries")
    sheets = spark.createDataFrame([(i, *x) for i, x in enumerate(_SHEETS)], "prompt_ord int, id string, english string, translation string")
    prompt_rows = countries.select("country").crossJoin(F.broadcast(sheets))  # 3 rows
    responses = table(spark, d, "model_inference_results")
    runs = prompts.matrix(responses.select("model"), countries, sheets.select(F.col("id").alias("prompt_no")))
    todo = prompts.inference(runs, _questions(spark, d), countries, prompt_rows, responses)
    return todo.select("model", "country", "language", "prompt_no", "id", "prompt")


def choose3(spark: SparkSession, d: str) -> DataFrame:
    """All choices of three of the regions."""
    items = table(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("items"))  # 5 rows
    return items.select(F.explode(choices.combinations(F.col("items"), F.lit(3))).alias("c")).select(*(F.get("c", F.lit(i)).alias(f"c{i + 1}") for i in range(3)))


def mc_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Questions assembled from nations: of every region its first
    nation by name is the answer, the others are distractors, as if regions were
    countries; here with the numbers and letters that follow."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # 25 rows, fixed
    regions = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("country_ord", F.col("r_regionkey").cast("int"))
    rest = F.transform(F.slice("names", 2, 10), lambda x: F.struct(F.lit("other").alias("country"), x.alias("answer")))
    chosen = regions.select(F.col("r_name").alias("country"), F.lit("q").alias("qid"), F.lit("Which nation of your country?").alias("question"), F.slice("names", 1, 1).alias("answers"), rest.alias("choices"))
    mc = choices.assemble(chosen, regions.select(F.col("r_name").alias("country"), "country_ord"))
    return mc.select("MCQID", "country", F.get(F.split("prompt", "\n\n"), F.lit(1)).alias("options"), "answer_idx")


def json_answer(spark: SparkSession, d: str) -> DataFrame:
    """the answer in JSON responses."""
    r = table(spark, d, "model_inference_results").select("resp_id", "response").distinct()
    return r.select("resp_id", F.try_element_at(T.json_object(F.col("response")), F.lit("answer")).alias("answer")).where("answer is not null")


def event_json(spark: SparkSession, d: str) -> DataFrame:
    """a field of JSON texts."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def keep_last_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user and type."""
    return keep_last(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def row_seq(spark: SparkSession, d: str) -> DataFrame:
    """Running number of a user's events."""
    e = running(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", {"cnt": F.lit(1)})
    return e.select("user_id", "event_id", (F.col("cnt") - 1).alias("cnt"))


def running_score(spark: SparkSession, d: str) -> DataFrame:
    """Running share of clicks of a user."""
    hit = F.coalesce((F.col("event_type") == "click").cast("int"), F.lit(0))
    e = running(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", {"hits": hit, "seen": F.lit(1)})
    return e.select("user_id", "event_id", F.round(F.col("hits") / F.col("seen"), 6).alias("score"))


def nfd_lemma(spark: SparkSession, d: str) -> DataFrame:
    """folded words of every last response, by language."""
    r = scoring.last_responses(table(spark, d, "model_inference_results"))
    return r.select("resp_id", lemma.lemmas_udf()(F.col("response"), F.col("language")).alias("words"))


def _named(*fs: Query) -> dict[str, Query]:
    return {f.__name__: f for f in fs}


QUERIES: dict[str, Query] = _named(
    soft_match, question_latest, question_first, prompt_render, prompt_matrix, resume_anti, question_semi, provider_route, last_response, response_normal, annotation_groups,
    valid_filter, idk_sum, question_filter, question_filter_wide, representative, max_vote_ties, weighted_vote, soft_scored, hard_match, results_table, cross_group, typed_answers, no_common_word, token_subset,
    answer_set, distractor_pick, distractor_greedy, min_choices, mc_questions, choose3, mc_assemble, json_answer, event_json, letter_extract, mc_score, keep_last_events, row_seq, running_score, nfd_lemma,
    soft_match_lemma, soft_scored_lemma, results_table_lemma, distractor_judged, filler_options, mc_given, running_mc_score, resume_choices, nested_answer, inference_rows,
)

_SP = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '[{_SP}]+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[/{_SP}]+'), lambda w: w <> '')"


_LAST_Q = "q AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY id, country ORDER BY updated_at DESC NULLS LAST, question DESC NULLS LAST) = 1)"
_ANN = "ann AS (SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY country, qid ORDER BY loaded_at DESC NULLS LAST, ann_id DESC NULLS LAST) = 1)"
_LAST_R = "r AS (SELECT * FROM model_inference_results QUALIFY row_number() OVER (PARTITION BY model, country, language, prompt_no, id ORDER BY received_at DESC NULLS LAST, resp_id DESC NULLS LAST) = 1)"
_HALF = "translate({x}, '：、，。', ':,,.')"
_NORMAL = f"""t AS (SELECT *, lower({_HALF.format(x="replace(response, prompt, '')")}) AS low, lower({_HALF.format(x='prompt')}) AS p FROM r),
lab AS (SELECT *, regexp_extract(low, '^([\\p{{L}}\\p{{N}}_]+:)\\s', 1) AS label FROM t),
norm AS (SELECT *, regexp_replace({_strip("CASE WHEN label <> '' AND contains(p, replace(label, ':', '')) THEN replace(low, label, '') ELSE low END")}, '^\\.+|\\.+$', '', 'g') AS nr FROM lab)"""
_VALID = "valid AS (SELECT * FROM ann WHERE coalesce(idks['no-answer'], 0) + coalesce(idks['not-applicable'], 0) < 3 AND coalesce(idks['idk'], 0) < 5 AND coalesce(len(annotations), 0) > 0)"
_REPS = f"""{_ANN},
g0 AS (SELECT country, qid, en_question AS question, unnest(annotations) AS g, generate_subscripts(annotations, 1) - 1 AS pos FROM ann),
g1 AS (SELECT country, qid, question, pos, {_strip('g.en_answers[1]')} AS answer, coalesce(g.count, 0) AS v FROM g0),
reps AS (SELECT country, qid, question, answer, arg_max(v, pos) AS votes, min(pos) AS pos FROM g1 WHERE answer IS NOT NULL AND answer <> '' GROUP BY ALL)"""
_TYPE = {
    "time": r"regexp_full_match({x}, '\p{{Nd}}{{2}}:\p{{Nd}}{{2}}')",
    "date": r"regexp_full_match({x}, '\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}')",
    "num": r"CASE WHEN NOT regexp_matches({s}, '[0-9.][dDfF]$') THEN TRY_CAST({s} AS DOUBLE) END",
}
_FITS = "CASE WHEN contains(question, 'HH:MM') THEN " + _TYPE["time"].format(x="answer") + " WHEN contains(question, 'MM/DD') THEN " + _TYPE["date"].format(x="answer") + " WHEN contains(question, 'Arabic') THEN (" + _TYPE["num"].format(s=_strip("answer")) + ") IS NOT NULL ELSE true END"


def _matches(a: str, r: str) -> str:
    low = f"lower({_strip(a)})"
    return f"(len({_tokens(a)}) > 0 AND (contains({r}, {low}) OR contains({r}, replace({low}, '-', ' ')) OR contains({r}, replace({low}, ' ', '-')) OR len(list_filter({_tokens(a)}, lambda w: NOT list_contains({_tokens(r)}, w))) = 0))"


_SOFT = f"""WITH {_ANN}, {_VALID}, {_LAST_R}, {_NORMAL},
j AS (SELECT norm.model, norm.country, norm.language, norm.prompt_no, norm.id, resp_id, nr, annotations FROM norm JOIN valid ON norm.country = valid.country AND norm.id = valid.qid),
grp AS (SELECT resp_id, language, nr, unnest(annotations) AS g, generate_subscripts(annotations, 1) AS pos FROM j),
ans AS (SELECT resp_id, nr, pos, g, unnest(list_concat(CASE WHEN language <> 'English' THEN coalesce(g.answers, []) ELSE [] END, coalesce(g.en_answers, []))) AS a FROM grp WHERE g IS NOT NULL),
hitc AS (SELECT resp_id, coalesce((SELECT x.g.count FROM ans x WHERE x.resp_id = h.resp_id AND x.pos = h.pos LIMIT 1), 0) AS c FROM (SELECT resp_id, min(pos) AS pos FROM ans WHERE coalesce(nr, '') <> '' AND a IS NOT NULL AND {_matches('a', 'nr')} GROUP BY resp_id) h),
scored AS (SELECT j.*, CASE WHEN hitc.resp_id IS NULL THEN 0 ELSE 1 END AS b, CASE WHEN hitc.resp_id IS NULL THEN 0.0 ELSE coalesce(hitc.c / nullif(coalesce(annotations[1].count, 0), 0), 0.0) END AS w FROM j LEFT JOIN hitc USING (resp_id))"""
_SOFT_RUNS = _SOFT + """,
den AS (SELECT country, count(*) AS questions FROM valid GROUP BY country),
agg AS (SELECT model, country, language, prompt_no, sum(b) AS h, sum(w) AS w FROM scored GROUP BY ALL),
runs AS (SELECT DISTINCT model, country, language, prompt_no FROM model_inference_results),
sem AS (SELECT runs.model, runs.country, runs.language, runs.prompt_no, questions, round(100 * coalesce(h, 0) / questions, 6) AS sem_b, round(100 * coalesce(agg.w, 0) / questions, 6) AS sem_w
FROM runs LEFT JOIN agg ON runs.model IS NOT DISTINCT FROM agg.model AND runs.country IS NOT DISTINCT FROM agg.country AND runs.language IS NOT DISTINCT FROM agg.language AND runs.prompt_no IS NOT DISTINCT FROM agg.prompt_no JOIN den ON runs.country = den.country)"""
_HARD = f"""hden AS (SELECT country, count(*) AS n FROM ann GROUP BY country),
hj AS (SELECT norm.model, norm.country, norm.language, norm.prompt_no, resp_id, nr, annotations, list_max(list_transform(annotations, lambda g: coalesce(g.count, 0))) AS most FROM norm JOIN ann ON norm.country = ann.country AND norm.id = ann.qid),
hgrp AS (SELECT resp_id, nr, unnest(annotations) AS g FROM hj),
hans AS (SELECT resp_id, nr, coalesce(g.count, 0) AS c, unnest(list_concat(coalesce(g.answers, []), coalesce(g.en_answers, []))) AS a FROM hgrp),
hhit AS (SELECT resp_id, max(c) AS c FROM hans WHERE lower({_strip('a')}) = nr AND nr <> '' GROUP BY resp_id),
hs AS (SELECT hj.*, CASE WHEN hhit.resp_id IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN hhit.resp_id IS NULL THEN 0.0 ELSE coalesce(hhit.c / nullif(most, 0), 0.0) END AS w FROM hj LEFT JOIN hhit USING (resp_id)),
hard AS (SELECT model, hs.country, language, prompt_no, round(100 * sum(h) / any_value(n), 6) AS em_b, round(100 * sum(w) / any_value(n), 6) AS em_w FROM hs JOIN hden ON hs.country = hden.country GROUP BY ALL)"""
_MERGED = """ SELECT * FROM (SELECT model, country, language, prompt_no, 'SEM-B' AS eval_method, sem_b AS score, 1 AS seq FROM sem UNION ALL SELECT model, country, language, prompt_no, 'SEM-W', sem_w, 1 FROM sem
UNION ALL SELECT model, country, language, prompt_no, 'SEM-B', em_b, 0 FROM hard UNION ALL SELECT model, country, language, prompt_no, 'SEM-W', em_w, 0 FROM hard) QUALIFY row_number() OVER (PARTITION BY model, country, language, prompt_no, eval_method ORDER BY seq DESC) = 1"""
_JSON = r"""d AS (SELECT DISTINCT resp_id, prompt, response FROM model_inference_results),
b AS (SELECT *, replace(replace(replace(regexp_extract(replace(response, chr(10), ''), '\{[^}]+\}'), '```json', ''), '`', ''), ',}', '}') AS body FROM d),
o AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body::JSON END AS j FROM b)"""
_ROUTE = "CASE " + " ".join(f"WHEN contains(model, '{p}') THEN '{n}'" for p, n in dims.PROVIDERS) + " WHEN model IS NOT NULL THEN 'local' END"

def _number(x: str) -> str:
    return _TYPE["num"].format(s=_strip(x))


def _fits(answer: str, question: str) -> str:
    return f"CASE WHEN contains({question}, 'HH:MM') THEN {_TYPE['time'].format(x=answer)} WHEN contains({question}, 'MM/DD') THEN {_TYPE['date'].format(x=answer)} WHEN contains({question}, 'Arabic') THEN ({_number(answer)}) IS NOT NULL ELSE true END"


def _alike(a: str, b: str, judge: str = "false") -> str:
    both = f"({_number(a)}) IS NOT NULL AND ({_number(b)}) IS NOT NULL"
    typed = " OR ".join(f"({_TYPE[k].format(x=a)} AND {_TYPE[k].format(x=b)})" for k in ("time", "date"))
    return f"CASE WHEN {both} THEN ({_number(a)}) = ({_number(b)}) AND NOT isnan({_number(a)}) ELSE contains({a}, {b}) OR contains({b}, {a}) OR list_has_any({_words(a)}, {_words(b)}) OR (NOT ({typed}) AND {judge}) END"


def _greedy(reps: str = "reps", judge: bool = False) -> str:
    """The greedy choice as a fold over candidates in order, by recursion."""
    like = lambda x: _alike(x, "c.answer", f"substring({x}, 1, 1) = substring(c.answer, 1, 1)" if judge else "false")
    skip = f"coalesce(c.country = f.country OR list_contains(list_transform(chosen, lambda x: x.country), c.country) OR list_contains(blocked, c.answer) OR NOT ({_fits('c.answer', 'f.question')}), false)"
    clash = f"(coalesce(len(list_filter(mine, lambda x: {like('x')})), 0) > 0 OR len(list_filter(chosen, lambda x: {like('x.answer')})) > 0)"
    return f"""own AS (SELECT country, qid, question, list(answer ORDER BY pos) FILTER (WHERE fit) AS mine, list(answer ORDER BY pos) FILTER (WHERE fit AND votes = most) AS answers
FROM (SELECT *, max(votes) OVER (PARTITION BY country, qid) AS most, {_fits('answer', 'question')} AS fit FROM {reps}) GROUP BY country, qid, question),
cand AS (SELECT qid, country, answer, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, country_ord, pos, country, answer) AS i FROM {reps} JOIN countries USING (country) WHERE votes >= 2),
fold AS (
SELECT country, qid, question, mine, 0::BIGINT AS i, []::STRUCT(country VARCHAR, answer VARCHAR)[] AS chosen, []::VARCHAR[] AS blocked FROM own
UNION ALL
SELECT country, qid, question, mine, i, CASE WHEN skip OR clash THEN chosen ELSE list_append(chosen, {{'country': c_country, 'answer': c_answer}}) END, CASE WHEN clash AND NOT skip THEN list_append(blocked, c_answer) ELSE blocked END
FROM (SELECT f.country, f.qid, f.question, f.mine, c.i, f.chosen, f.blocked, c.country AS c_country, c.answer AS c_answer, {skip} AS skip, {clash} AS clash FROM fold f JOIN cand c ON c.qid = f.qid AND c.i = f.i + 1)),
picked AS (SELECT country, qid, chosen FROM fold QUALIFY row_number() OVER (PARTITION BY country, qid ORDER BY i DESC) = 1)"""


_WITH = f"WITH RECURSIVE {_REPS}"
_PICKS = "SELECT country, qid, (n - 1)::BIGINT AS n, c.country AS other_country, c.answer AS answer FROM (SELECT country, qid, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS n FROM picked)"
_FILLERS = """fopt AS (SELECT qid, r_name AS option FROM (SELECT DISTINCT qid FROM reps), region UNION SELECT qid, answer FROM reps WHERE pos = 0),
fill AS (SELECT DISTINCT qid, lower(option) AS option FROM fopt f WHERE NOT EXISTS (SELECT 1 FROM reps r WHERE r.qid = f.qid AND r.answer = f.option))"""
_FIT = "fit AS (SELECT qid FROM ann GROUP BY qid HAVING NOT bool_or(coalesce(idks['not-applicable'], 0) > 4 OR coalesce(list_sum(map_values(idks)), 0) > 7 OR (coalesce(len(annotations[1].en_answers), 0) > 0 AND coalesce(annotations[1].count, 0) < 1)))"


def _assembled(all_countries: bool) -> str:
    """Multiple-choice questions from `picked` and `own`."""
    few = "CASE WHEN count(*) < (SELECT count(*) FROM countries) THEN 0 ELSE min(len(chosen)) END" if all_countries else "min(len(chosen))"
    extra = "list_transform(coalesce(options, []::VARCHAR[])[1:greatest(3 - m, 0)], lambda x: {'v': x, 'k': 'dummy'})" if all_countries else "[]::STRUCT(v VARCHAR, k VARCHAR)[]"
    up = lambda a, b, inner: f"list_transform(range({a}, {b}), lambda {inner})"
    two = f"flatten({up(1, 'n + 1', 'i: ' + up('i + 1', 'n + 1', 'j: [i, j]'))})"
    three = f"flatten(flatten({up(1, 'n + 1', 'i: ' + up('i + 1', 'n + 1', 'j: ' + up('j + 1', 'n + 1', 'k: [i, j, k]')))}))"
    entries = lambda f: f"'{{' || array_to_string(list_transform(opts, lambda o, i: '\"' || chr((64 + i)::INT) || '\":' || to_json(o.{f})::VARCHAR), ',') || '}}'"
    return f"""few AS (SELECT qid, least({few}, 3) AS m FROM picked GROUP BY qid),
flist AS (SELECT qid, list_sort(list(option)) AS options FROM fill GROUP BY qid),
b0 AS (SELECT o.country, o.qid, o.question, o.answers, p.chosen, len(p.chosen) AS n, m, {extra} AS extra, country_ord FROM picked p JOIN own o ON p.country = o.country AND p.qid = o.qid JOIN few ON few.qid = p.qid LEFT JOIN flist ON flist.qid = p.qid JOIN countries k ON k.country = p.country),
b1 AS (SELECT *, CASE m WHEN 0 THEN [[]]::BIGINT[][] WHEN 1 THEN list_transform(range(1, n + 1), lambda i: [i]) WHEN 2 THEN {two} ELSE {three} END AS combos FROM b0 WHERE m + len(extra) >= 3),
b2 AS (SELECT *, unnest(answers) AS answer, generate_subscripts(answers, 1) AS ap FROM b1),
b3 AS (SELECT *, unnest(combos) AS combo, generate_subscripts(combos, 1) AS cp FROM b2),
b4 AS (SELECT *, list_sort(list_concat(list_concat(list_transform(combo, lambda p: {{'v': chosen[p].answer, 'k': chosen[p].country}}), [{{'v': answer, 'k': country}}]), extra)) AS opts, row_number() OVER (PARTITION BY qid ORDER BY country_ord, ap, cp) - 1 AS cnt FROM b3),
mc AS (SELECT qid || '_' || cnt AS MCQID, qid AS ID, country, cnt AS n, opts, replace(question, 'your country', CASE WHEN country IN ('US', 'UK') THEN 'the ' || country ELSE replace(country, '_', ' ') END) || '{choices.INSTRUCTION.replace(chr(10), "' || chr(10) || '")}' || array_to_string(list_transform(opts, lambda o, i: chr((64 + i)::INT) || '. ' || o.v || chr(10)), '') || chr(10) || 'Answer:' AS prompt,
{entries('v')} AS choices, {entries('k')} AS choice_countries, chr((64 + list_max(list_transform(opts, lambda o, i: CASE WHEN o.v = answer THEN i END)))::INT) AS answer_idx FROM b4)"""


_FIT_REPS = f"{_FIT}, freps AS (SELECT * FROM reps WHERE qid IN (SELECT qid FROM fit))"
_MC = f"{_WITH}, {_FIT_REPS}, {_FILLERS}, {_greedy('freps')}, {_assembled(True)}"
_MC_ANSWERS = _MC + """,
asked AS (SELECT mc.*, model, chr((65 + (n + length(prompt) + CASE WHEN model = 'm1' THEN 1 ELSE 0 END) % 4)::INT) AS letter FROM mc, (SELECT unnest(['m0', 'm1']) AS model)),
said AS (SELECT *, n % 5 AS form, opts[ascii(letter) - 64].v AS by_letter FROM asked),
ans AS (SELECT *, CASE form WHEN 0 THEN letter WHEN 2 THEN 'I' WHEN 3 THEN '{"choice":"A"}' WHEN 4 THEN letter
ELSE CASE WHEN by_letter IS NULL THEN NULL
WHEN regexp_extract(by_letter, '[A-Z]') <> '' AND contains(prompt, regexp_extract(by_letter, '[A-Z]') || '.') THEN regexp_extract(by_letter, '[A-Z]')
WHEN contains(by_letter, '"') OR contains(by_letter, '}') OR contains(by_letter, chr(92)) THEN 'odd'
ELSE chr((64 + list_min(list_transform(opts, lambda o, i: CASE WHEN o.v = by_letter THEN i END)))::INT) END END AS final_ans FROM said)"""


def _acute() -> tuple[str, str]:
    """Composed letters with an acute accent, and what remains without it."""
    composed = [c for c in map(chr, range(0xC0, 0x2000)) if "́" in unicodedata.normalize("NFD", c) and len(unicodedata.normalize("NFC", c)) == 1]
    bare = [unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).replace("́", "")) for c in composed]
    kept = [(c, b) for c, b in zip(composed, bare, strict=True) if len(b) == 1]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


def _lemma_words(x: str, language: str) -> str:
    """Folded words by language, as composed text without acute accents."""
    parts = lambda text, kept: f"list_filter(regexp_split_to_array(translate(regexp_replace(translate({text}, '{kept}', chr(57344)), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), chr(57344), '{kept}'), '[{_SP}]+'), lambda w: w <> '')"
    nfc = f"nfc_normalize({x})"
    apostrophe = "''"
    azeri = f"regexp_replace(replace(replace({nfc}, 'İ', 'I'), 'i' || chr(775), 'i'), '[\"''“”]', '', 'g')"
    by_language = f"CASE {language} WHEN 'Chinese' THEN regexp_extract_all({nfc}, '[\\p{{L}}\\p{{N}}]') WHEN 'Azerbaijani' THEN list_filter({parts(azeri, '-')}, lambda w: trim(w, '-') <> '') WHEN 'Sundanese' THEN {parts(f"regexp_replace({nfc}, '[()]', '', 'g')", apostrophe)} ELSE {parts(nfc, apostrophe)} END"
    old, new = _acute()
    return f"list_filter(list_transform({by_language}, lambda w: nfc_normalize(lower(replace(translate(replace(w, 'İ', 'I' || chr(775)), '{old}', '{new}'), chr(769), '')))), lambda w: w <> '')"


def _lemma_soft(sql: str) -> str:
    """The SQL of plain words with folded ones, made once a response and answer."""
    low = f"lower({_strip('a')})"
    plain = f"coalesce(nr, '') <> '' AND a IS NOT NULL AND {_matches('a', 'nr')}"
    folded = f"coalesce(nr, '') <> '' AND a IS NOT NULL AND len({_tokens('a')}) > 0 AND (contains(nr, {low}) OR contains(nr, replace({low}, '-', ' ')) OR contains(nr, replace({low}, ' ', '-')) OR (len(aw) > 0 AND len(list_filter(aw, lambda w: NOT list_contains(rw, w))) = 0))"
    assert plain in sql
    old = sql[sql.index("ans AS (SELECT resp_id") : sql.index("hitc AS (")]
    new = f"""ans0 AS (SELECT resp_id, nr, pos, g, language, unnest(list_concat(CASE WHEN language <> 'English' THEN list_transform(coalesce(g.answers, []), lambda x: {{'a': x, 'l': language}}) ELSE [] END, list_transform(coalesce(g.en_answers, []), lambda x: {{'a': x, 'l': 'English'}}))) AS e FROM grp WHERE g IS NOT NULL),
aw AS (SELECT a AS x, l, {_lemma_words(f"lower({_strip('a')})", 'l')} AS aw FROM (SELECT DISTINCT e.a AS a, e.l AS l FROM ans0 WHERE e.a IS NOT NULL)),
rw AS (SELECT nr AS y, l, {_lemma_words('nr', 'l')} AS rw FROM (SELECT DISTINCT nr, e.l AS l FROM ans0 WHERE nr IS NOT NULL)),
ans AS (SELECT resp_id, nr, pos, g, e.a AS a, aw, rw FROM ans0 LEFT JOIN aw ON aw.x = e.a AND aw.l = e.l LEFT JOIN rw ON rw.y = nr AND rw.l = e.l),
"""
    return sql.replace(old, new).replace(plain, folded)


SQL: dict[str, str] = {
    "soft_match": _SOFT_RUNS + " SELECT * FROM sem",
    "soft_scored": _SOFT + " SELECT resp_id, id, country, b AS binary_score, round(w, 6) AS weight_score FROM scored",
    "results_table": f"{_SOFT_RUNS}, {_HARD} SELECT model, country, language, prompt_no, eval_method, score FROM ({_MERGED})",
    "soft_match_lemma": _lemma_soft(_SOFT_RUNS) + " SELECT * FROM sem",
    "soft_scored_lemma": _lemma_soft(_SOFT) + " SELECT resp_id, id, country, b AS binary_score, round(w, 6) AS weight_score FROM scored",
    "results_table_lemma": f"{_lemma_soft(_SOFT_RUNS)}, {_HARD} SELECT model, country, language, prompt_no, eval_method, score FROM ({_MERGED})",
    "hard_match": f"WITH {_ANN}, {_LAST_R}, {_NORMAL}, {_HARD} SELECT * FROM hard",
    "question_latest": f"WITH {_LAST_Q} SELECT id, country, lower({_strip('topic')}) AS topic, source, {_strip('question')} AS question FROM q",
    "question_first": "SELECT id, country, question FROM questions QUALIFY row_number() OVER (PARTITION BY id, country ORDER BY updated_at ASC NULLS FIRST, question ASC NULLS FIRST) = 1",
    "prompt_render": f"""WITH {_LAST_Q}, j AS (SELECT q.*, c.language AS native FROM q JOIN countries c USING (country)),
legs AS (SELECT *, unnest(CASE WHEN native = 'English' THEN ['English'] ELSE [native, 'English'] END) AS language FROM j),
t AS (SELECT *, CASE WHEN language = native THEN translation WHEN language = 'English' THEN question END AS x FROM legs)
SELECT id, country, language, replace('Answer briefly.' || chr(10) || chr(10) || 'Question: {{q}}' || chr(10) || 'Answer:', '{{q}}', CASE WHEN language = 'English' AND native <> 'English' THEN replace(x, 'your country', replace(country, '_', ' ')) ELSE x END) AS prompt FROM t WHERE x IS NOT NULL""".replace("{{q}}", "{q}"),
    "prompt_matrix": """SELECT m.model, c.country, p.prompt_no, unnest(CASE WHEN c.language = 'English' THEN ['English'] ELSE [c.language, 'English'] END) AS language
FROM (SELECT DISTINCT model FROM model_inference_results) m, countries c, (SELECT DISTINCT prompt_no FROM model_inference_results WHERE prompt_no IS NOT NULL) p""",
    "resume_anti": "SELECT DISTINCT id, country FROM questions q WHERE NOT EXISTS (SELECT 1 FROM model_inference_results r WHERE r.id = q.id AND r.country = q.country)",
    "question_semi": "SELECT DISTINCT country, qid FROM annotations a WHERE EXISTS (SELECT 1 FROM model_inference_results r WHERE r.id = a.qid AND r.country = a.country)",
    "provider_route": f"SELECT model, {_ROUTE} AS provider, count(*) AS n FROM model_inference_results GROUP BY model",
    "last_response": f"WITH {_LAST_R} SELECT model, country, language, prompt_no, id, resp_id, response FROM r",
    "response_normal": f"WITH {_LAST_R}, {_NORMAL} SELECT resp_id, nr AS normal FROM norm",
    "annotation_groups": f"WITH {_ANN}, g AS (SELECT country, qid, unnest(annotations) AS g, generate_subscripts(annotations, 1) - 1 AS grp FROM ann) SELECT country, qid, grp, coalesce(len(g.answers), 0) AS n_answers, coalesce(len(g.en_answers), 0) AS n_en, g.count AS votes FROM g",
    "valid_filter": f"WITH {_ANN}, {_VALID} SELECT country, qid FROM valid",
    "idk_sum": f"WITH {_ANN} SELECT country, qid, coalesce(list_sum(map_values(idks)), 0)::BIGINT AS idk_votes FROM ann",
    "question_filter": f"""WITH {_ANN} SELECT qid FROM ann GROUP BY qid HAVING NOT bool_or(coalesce(idks['not-applicable'], 0) > 0 OR coalesce(list_sum(map_values(idks)), 0) > 2 OR (coalesce(len(annotations[1].en_answers), 0) > 0 AND coalesce(annotations[1].count, 0) < 2))""",
    "question_filter_wide": f"""WITH {_ANN} SELECT qid FROM ann GROUP BY qid HAVING NOT bool_or(coalesce(idks['not-applicable'], 0) > 4 OR coalesce(list_sum(map_values(idks)), 0) > 7 OR (coalesce(len(annotations[1].en_answers), 0) > 0 AND coalesce(annotations[1].count, 0) < 1))""",
    "representative": f"WITH {_REPS} SELECT country, qid, answer, votes, pos FROM reps",
    "max_vote_ties": f"WITH {_REPS} SELECT country, qid, answer, votes FROM (SELECT *, max(votes) OVER (PARTITION BY country, qid) AS m FROM reps) WHERE votes = m AND {_FITS}",
    "weighted_vote": f"WITH {_REPS} SELECT country, qid, answer, round(votes / nullif(max(votes) OVER (PARTITION BY country, qid), 0), 6) AS weight FROM reps",
    "cross_group": f"WITH {_REPS} SELECT a.qid, a.answer, a.country AS country_a, b.country AS country_b FROM reps a JOIN reps b ON a.qid = b.qid AND a.answer = b.answer AND a.country < b.country",
    "typed_answers": f"""WITH a AS (SELECT DISTINCT unnest(g.en_answers) AS answer FROM (SELECT unnest(annotations) AS g FROM annotations)), s AS (SELECT answer, {_strip('answer')} AS x FROM a WHERE answer IS NOT NULL)
SELECT answer, {_TYPE['time'].format(x='x')} AS is_time, {_TYPE['date'].format(x='x')} AS is_date, ({_TYPE['num'].format(s='x')}) IS NOT NULL AS is_number FROM s""",
    "no_common_word": f"""WITH {_REPS}, f AS (SELECT country, qid, answer AS x, {_TYPE['num'].format(s=_strip('answer'))} AS n FROM reps WHERE pos = 0)
SELECT a.qid, a.country AS country_a, b.country AS country_b, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.n <> b.n OR isnan(a.n) ELSE NOT (contains(a.x, b.x) OR contains(b.x, a.x)) AND NOT list_has_any({_words('a.x')}, {_words('b.x')}) END AS differ
FROM f a JOIN f b ON a.qid = b.qid AND a.country < b.country""",
    "token_subset": f"WITH {_REPS} SELECT country, qid, answer FROM reps WHERE len({_tokens('answer')}) > 0 AND len(list_filter({_tokens('answer')}, lambda w: NOT list_contains({_tokens('question')}, w))) = 0",
    "answer_set": f"WITH {_REPS} SELECT qid, count(DISTINCT answer) AS answers, count(DISTINCT country) AS countries FROM reps GROUP BY qid",
    "distractor_pick": f"""WITH {_REPS}, own AS (SELECT DISTINCT country, qid FROM reps)
SELECT o.country, o.qid, c.country AS other_country, c.answer, c.votes FROM own o JOIN reps c ON o.qid = c.qid AND o.country <> c.country AND c.votes >= 2
WHERE NOT EXISTS (SELECT 1 FROM reps m WHERE m.country = o.country AND m.qid = o.qid AND m.answer = c.answer) QUALIFY row_number() OVER (PARTITION BY o.country, o.qid, c.country ORDER BY c.votes DESC, c.pos) = 1""",
    "choose3": "SELECT a.r_name AS c1, b.r_name AS c2, c.r_name AS c3 FROM region a JOIN region b ON a.r_name < b.r_name JOIN region c ON b.r_name < c.r_name",
    "mc_assemble": """WITH n AS (SELECT r_name, r_regionkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT z.r_name AS country, z.r_regionkey AS o, z.n_name AS answer, list_sort([z.n_name, a.n_name, b.n_name, d.n_name]) AS opts, a.i AS i1, b.i AS i2, d.i AS i3 FROM n z JOIN n a ON a.r_regionkey = z.r_regionkey AND a.i > 1 JOIN n b ON b.r_regionkey = z.r_regionkey AND b.i > a.i JOIN n d ON d.r_regionkey = z.r_regionkey AND d.i > b.i WHERE z.i = 1)
SELECT 'q_' || (row_number() OVER (ORDER BY o, i1, i2, i3) - 1) AS MCQID, country, array_to_string(list_transform(opts, lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10)) AS options, chr((64 + list_position(opts, answer))::INT) AS answer_idx FROM c""",
    "distractor_greedy": f"{_WITH}, {_greedy()} {_PICKS}",
    "distractor_judged": f"{_WITH}, {_greedy(judge=True)} {_PICKS}",
    "min_choices": f"{_WITH}, {_greedy()} SELECT qid, CASE WHEN count(*) < (SELECT count(*) FROM countries) THEN 0 ELSE min(len(chosen)) END::BIGINT AS least FROM picked WHERE country IS NOT NULL GROUP BY qid",
    "filler_options": f"WITH {_REPS}, {_FILLERS} SELECT qid, option FROM fill",
    "mc_questions": _MC + " SELECT MCQID, ID, country, prompt, choices, choice_countries, answer_idx FROM mc",
    "mc_given": f"{_WITH}, {_FIT_REPS}, {_FILLERS}, {_greedy('freps')}, {_assembled(False)} SELECT ID, country, answer_idx, count(*) AS n, min(MCQID) AS first_id, max(choices) AS last_choices FROM mc GROUP BY ALL",
    "letter_extract": _MC_ANSWERS + " SELECT model, MCQID, final_ans FROM ans",
    "mc_score": _MC_ANSWERS + " SELECT model, country, round(avg(CASE WHEN coalesce(answer_idx, 'nan') = coalesce(final_ans, 'nan') THEN 1 ELSE 0 END), 6) AS score FROM ans GROUP BY model, country",
    "running_mc_score": _MC_ANSWERS + " SELECT model, MCQID, round(avg(CASE WHEN final_ans = answer_idx THEN 1 ELSE 0 END) OVER (PARTITION BY model, ID ORDER BY n ROWS UNBOUNDED PRECEDING), 6) AS score FROM ans",
    "resume_choices": f"WITH {_ANN}, last AS (SELECT country FROM countries ORDER BY country_ord DESC LIMIT 1) SELECT DISTINCT qid FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM ann b WHERE b.qid = a.qid AND b.country = (SELECT country FROM last) AND len(b.annotations) > 0)",
    "nested_answer": r"""WITH d AS (SELECT DISTINCT resp_id, response FROM model_inference_results),
b AS (SELECT resp_id, regexp_extract(replace(replace(replace(replace(response, chr(10), ''), '```json', ''), '`', ''), ',}', '}'), '\{.+\}') AS body FROM d)
SELECT resp_id, body FROM b WHERE body <> '' AND json_valid(body)""",
    "inference_rows": f"""WITH {_LAST_Q}, s AS (SELECT * FROM (VALUES {", ".join("('" + i + "', '" + e.replace(chr(10), "' || chr(10) || '") + "', '" + t.replace(chr(10), "' || chr(10) || '") + "')" for i, e, t in _SHEETS[:2])}) AS v(prompt_no, en, tr)),
runs AS (SELECT m.model, c.country, c.language AS native, s.prompt_no, s.en, s.tr, unnest(CASE WHEN c.language = 'English' THEN ['English'] ELSE [c.language, 'English'] END) AS language FROM (SELECT DISTINCT model FROM model_inference_results) m, countries c, s),
x AS (SELECT r.model, r.country, r.language, r.prompt_no, q.id, CASE WHEN r.language = 'English' AND native <> 'English' THEN replace(q.question, 'your country', replace(r.country, '_', ' ')) WHEN r.language = native THEN q.translation END AS text, CASE WHEN r.language = 'English' THEN en ELSE tr END AS tmpl FROM runs r JOIN q ON q.country = r.country)
SELECT model, country, language, prompt_no, id, replace(tmpl, '{{q}}', text) AS prompt FROM x WHERE NOT EXISTS (SELECT 1 FROM model_inference_results d WHERE d.model = x.model AND d.country = x.country AND d.language = x.language AND d.prompt_no = x.prompt_no AND d.id = x.id)""",
    "json_answer": f"""WITH {_JSON} SELECT resp_id, CASE WHEN json_type(j, '$.answer') = 'VARCHAR' THEN j ->> '$.answer' ELSE CAST(j -> '$.answer' AS VARCHAR) END AS answer FROM o WHERE json_type(j, '$.answer') IS NOT NULL AND json_type(j, '$.answer') <> 'NULL'""",
    "event_json": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events",
    "keep_last_events": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "row_seq": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cnt FROM events",
    "running_score": "SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS score FROM events",
}
