"""Scores of short answers against annotated ones.

Defined results: null vote counts are 0; null groups, null and blank answers
match nothing; a question without a response counts in the denominator and
scores 0; a first group without votes gives weight 0; a country without valid
questions has no score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquill.functions import lemma
from polyquill.functions import text as T
from polyquill.operators.latest import keep_last

RUN = ["model", "country", "language", "prompt_no"]


def latest_annotations(annotations: DataFrame, *columns: str) -> DataFrame:
    """One record per (country, qid) with the columns named: of its rows the one
    loaded last. Only these columns are read and shuffled."""
    return keep_last(annotations.select("country", "qid", *columns, "loaded_at", "ann_id"), ["country", "qid"], ["loaded_at", "ann_id"])


def idk(idks: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(idks, F.lit(key)), F.lit(0))


def is_valid(annotations: Column, idks: Column) -> Column:
    """Whether a question counts: it has groups, fewer than 3 votes for no
    answer or not applicable, and fewer than 5 for not knowing."""
    return (idk(idks, "no-answer") + idk(idks, "not-applicable") < 3) & (idk(idks, "idk") < 5) & (F.coalesce(F.size(annotations), F.lit(0)) > 0)


def last_normal(responses: DataFrame) -> DataFrame:
    """Of each run and question the response that came last, as it is matched
    (`_r`): read before the shuffle, so that prompts and responses need not travel."""
    normal = T.normal_response(F.col("response"), F.col("prompt")).alias("_r")
    return keep_last(responses.select(*RUN, "id", "resp_id", normal, "received_at"), [*RUN, "id"], ["received_at", "resp_id"]).drop("received_at")


def last_responses(responses: DataFrame) -> DataFrame:
    """Of each run and question the response that came last."""
    return keep_last(responses.select(*RUN, "id", "resp_id", "prompt", "response", "received_at"), [*RUN, "id"], ["received_at", "resp_id"])


def _votes(group: Column) -> Column:
    return F.coalesce(group["count"], F.lit(0))


def readable(field: Column) -> Column:
    """Answers with what a match needs of them, taken once an annotation."""
    return F.transform(field, lambda a: F.struct(F.lower(T.strip(a)).alias("low"), T.tokens(a).alias("words"), a.alias("answer")))


def first_hit(groups: Column, response: Column, native: Column, words: Column, folded: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """The first group in list order one of whose readable answers the response
    gives: native answers if the language is not English, then English ones.
    `words` are the response's; `folded` has for either field a map of the
    answers' folded words and the response's, which stand for them."""

    def hit(g: Column) -> Column:
        def some(field: str) -> Column:
            def gives(a: Column) -> Column:
                own, given = (F.try_element_at(folded[field][0], a["answer"]), folded[field][1]) if folded else (a["words"], words)
                inside = response.contains(a["low"]) | response.contains(F.replace(a["low"], F.lit("-"), F.lit(" "))) | response.contains(F.replace(a["low"], F.lit(" "), F.lit("-")))
                return F.coalesce((F.size(a["words"]) > 0) & (inside | ((F.size(own) > 0) & (F.size(F.array_except(own, given)) == 0))), F.lit(False))

            return F.coalesce(F.exists(g[field], gives), F.lit(False))

        return (native & some("answers")) | some("en_answers")

    return F.get(F.filter(groups, hit), F.lit(0))


def valid_annotations(annotations: DataFrame) -> DataFrame:
    """Latest records that count. Keys without country or id can match nothing;
    told here, so that every use has the same plan and shares one shuffle."""
    keyed = annotations.where("country is not null and qid is not null")
    return latest_annotations(keyed, "annotations", "idks").where(is_valid(F.col("annotations"), F.col("idks")))


def _answer_words(field: str, languages: Column) -> Column:
    """By language, folded words of every distinct answer in the groups by answer."""
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.array_compact(F.flatten(F.transform("annotations", lambda g: F.coalesce(g[field], none)))))
    words = lemma.lists_udf()(F.transform(every, lambda a: F.lower(T.strip(a))), languages)
    return F.map_from_arrays(languages, F.transform(words, lambda w: F.map_from_arrays(every, w)))


def soft_scored(responses: DataFrame, annotations: DataFrame, lemmas: bool = False) -> DataFrame:
    """Every last response to a valid question with binary_score (0 or 1) and
    weight_score (votes of the group it hits by votes of the first group). With
    `lemmas`, words are those of the registered tokenisers, folded: native
    answers in the response's language, English ones in English."""
    valid = valid_annotations(annotations).select("country", F.col("qid").alias("id"), "annotations")
    native = F.coalesce(F.col("language") != "English", F.lit(False))
    last = last_normal(responses).withColumn("_words", T.tokens(F.col("_r")))
    groups = F.transform("annotations", lambda g: F.when(g.isNotNull(), F.struct(g["count"].alias("count"), readable(g["answers"]).alias("answers"), readable(g["en_answers"]).alias("en_answers"))))
    valid = valid.withColumn("_groups", groups)
    if lemmas:
        # Answers are folded once a question and language, before they meet the
        # responses; a country has a few languages, so nothing is shuffled again.
        spoken = responses.where(native).groupBy("country").agg(F.array_sort(F.collect_set("language")).alias("_spoken"))
        valid = valid.join(spoken, "country", "left").withColumn("_en", _answer_words("en_answers", F.array(F.lit("English")))).withColumn("_own", _answer_words("answers", F.col("_spoken")))
    both = last.join(valid.drop("annotations"), ["country", "id"])
    folded = None
    if lemmas:
        fold = lemma.lemmas_udf()
        both = both.withColumn("_r_en", fold(F.col("_r"), F.lit("English"))).withColumn("_r_own", fold(F.when(native, F.col("_r")), F.col("language")))
        folded = {"answers": (F.try_element_at("_own", F.col("language")), F.col("_r_own")), "en_answers": (F.try_element_at("_en", F.lit("English")), F.col("_r_en"))}
    both = both.withColumn("_hit", F.when(F.coalesce(F.col("_r"), F.lit("")) != "", first_hit(F.col("_groups"), F.col("_r"), native, F.col("_words"), folded)))
    weight = F.coalesce(F.try_divide(_votes(F.col("_hit")), _votes(F.get("_groups", F.lit(0)))), F.lit(0.0))
    return both.select(*RUN, "id", "resp_id", F.col("_hit").isNotNull().cast("int").alias("binary_score"), F.when(F.col("_hit").isNotNull(), weight).otherwise(0.0).alias("weight_score"))


def soft_match(responses: DataFrame, annotations: DataFrame, lemmas: bool = False) -> DataFrame:
    """SEM-B and SEM-W of every run in percent of its country's valid
    questions. Denominators come from the annotations alone, so runs and
    questions are never multiplied out."""
    valid = valid_annotations(annotations).groupBy("country").agg(F.count(F.lit(1)).alias("valid"))
    got = soft_scored(responses, annotations, lemmas).groupBy(*RUN).agg(F.sum("binary_score").alias("hits"), F.sum("weight_score").alias("weight"))
    runs = responses.select(*RUN).distinct()
    same = [runs[c].eqNullSafe(got[c]) for c in RUN]
    rows = runs.join(got, same, "left").select(*(runs[c] for c in RUN), "hits", "weight").join(valid, "country")
    pct = lambda c: F.round(100 * F.coalesce(F.col(c), F.lit(0)) / F.col("valid"), 6)
    return rows.select(*RUN, F.col("valid").alias("questions"), pct("hits").alias("sem_b"), pct("weight").alias("sem_w"))


def hard_match(responses: DataFrame, annotations: DataFrame) -> DataFrame:
    """As soft_match with equality: the response is one of the answers; weight
    by the greatest vote; all annotated questions count."""
    ann = latest_annotations(annotations, "annotations")
    total = ann.groupBy("country").agg(F.count(F.lit(1)).alias("all_questions"))
    most = F.array_max(F.transform("annotations", _votes))
    both = last_normal(responses).join(ann.select("country", F.col("qid").alias("id"), "annotations"), ["country", "id"])
    answers = lambda g: F.coalesce(F.exists(F.concat(F.coalesce(g["answers"], F.array().cast("array<string>")), F.coalesce(g["en_answers"], F.array().cast("array<string>"))), lambda a: F.coalesce(F.lower(T.strip(a)) == F.col("_r"), F.lit(False))), F.lit(False))
    best = F.array_max(F.transform(F.filter("annotations", answers), _votes))
    hit = F.coalesce(best.isNotNull() & (F.col("_r") != ""), F.lit(False))
    got = both.select(*RUN, hit.cast("int").alias("h"), F.when(hit, F.coalesce(F.try_divide(best, most), F.lit(0.0))).otherwise(0.0).alias("w"))
    return got.groupBy(*RUN).agg(F.sum("h").alias("h"), F.sum("w").alias("w")).join(total, "country").select(*RUN, F.round(100 * F.col("h") / F.col("all_questions"), 6).alias("em_b"), F.round(100 * F.col("w") / F.col("all_questions"), 6).alias("em_w"))


def as_results(scores: DataFrame) -> DataFrame:
    """One row per method: model, country, language, prompt_no, eval_method, score."""
    pairs = F.array(F.struct(F.lit("SEM-B").alias("eval_method"), F.col("sem_b").alias("score")), F.struct(F.lit("SEM-W").alias("eval_method"), F.col("sem_w").alias("score")))
    return scores.select(*RUN, F.explode(pairs).alias("_m")).select(*RUN, "_m.eval_method", "_m.score")


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results with the last score of every key; `new` stands over `old`."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return keep_last(both, [*RUN, "eval_method"], ["_seq"]).drop("_seq")


def choice_accuracy(answered: DataFrame) -> DataFrame:
    """Share of multiple-choice answers that are right, by model and country;
    a null compares as the word nan."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return answered.groupBy("model", "country").agg(F.avg((word("answer_idx") == word("final_ans")).cast("int")).alias("score"))
