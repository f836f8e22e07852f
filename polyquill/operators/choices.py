"""Multiple-choice questions from other countries' answers.

The greedy choice of distractors is a fold over the candidates of a question in
a fixed order; what counts as similar is decided by text, and by a table of
judged pairs where one is given. Questions are independent, so no order between
them matters. A question's answers are one list: its size follows from the
number of countries, not from the data. The fold runs in Python, where what an
answer is similar to is found once a question and kept as bits.

Defined results: null and blank English answers are none; of an answer given by
several groups the last group's votes and the first one's place stand; null
votes are 0; a country without annotations has no choices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyquill.functions import text as T
from polyquill.operators.prompts import name_country_always
from polyquill.operators.scoring import latest_annotations

MIN_VOTES = 2
OPTIONS = 3
# Fixed value: what follows the question.
INSTRUCTION = ' Without any explanation, choose only one from the given alphabet choices(e.g., A, B, C). Provide as JSON format: {"answer_choice":""}\n\n'


def representative(annotations: DataFrame) -> DataFrame:
    """(country, qid, question, answer, votes, pos): the first English answer
    of each group of the latest records."""
    groups = latest_annotations(annotations, "en_question", "annotations").select("country", "qid", F.col("en_question").alias("question"), F.posexplode("annotations").alias("pos", "g"))
    answer = T.strip(F.get("g.en_answers", F.lit(0)))
    rows = groups.select("country", "qid", "question", "pos", answer.alias("answer"), F.coalesce("g.count", F.lit(0)).alias("votes")).where("answer is not null and answer <> ''")
    return rows.groupBy("country", "qid", "question", "answer").agg(F.max_by("votes", "pos").alias("votes"), F.min("pos").alias("pos"))


def top_answers(reps: DataFrame) -> DataFrame:
    """Answers with the most votes of their question, ties included. The most
    is taken before the format is tested, so there may be none."""
    best = reps.groupBy("country", "qid").agg(F.max("votes").alias("most"))
    return reps.join(best, ["country", "qid"]).where((F.col("votes") == F.col("most")) & T.fits_question(F.col("answer"), F.col("question"))).select("country", "qid", "answer", "votes")


def question_filter(annotations: DataFrame, most_na: int = 0, most_idks: int = 2, least_votes: int = MIN_VOTES) -> DataFrame:
    """Questions fit for choices: no country finds one not applicable, has more
    than two idks in all, or a top answer with fewer than two votes."""
    ann = latest_annotations(annotations, "annotations", "idks")
    idks = F.aggregate(F.coalesce(F.map_values("idks"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    first = F.get("annotations", F.lit(0))
    weak = (F.coalesce(F.size(first["en_answers"]), F.lit(0)) > 0) & (F.coalesce(first["count"], F.lit(0)) < least_votes)
    bad = (F.coalesce(F.try_element_at("idks", F.lit("not-applicable")), F.lit(0)) > most_na) | (idks > most_idks) | weak
    return ann.groupBy("qid").agg(F.max(bad.cast("int")).alias("bad")).where("bad = 0").select("qid")


#: What questions ask for, as `text.fits_question` tells it; the last takes anything.
_FORMATS = ("HH:MM", "MM/DD", "Arabic", "")
_TIME, _DATE = 1, 2
_PARTS = re.compile(f"[/{T.BLANKS}]+")
_CHOSEN = "country string, qid string, question string, answers array<string>, choices array<struct<country:string,answer:string>>"
#: Questions of a batch that leaves the fold: their rows hold lists.
_BATCH = 500


def _least_first(x: object) -> tuple:
    """Sorts as Spark does: nulls first."""
    return (x is not None, x)


def _alike(texts: list[str], nums: list[float | None], forms: list[int], judged: tuple[set[str], set[str], bool] | None) -> list[int]:
    """Of each text the texts it is similar to, as bits. By text first: numbers
    by value, others if one contains the other or they share a word. What text
    leaves apart is settled by format where both are numbers, times or dates
    (then they differ), else by the judged pairs: `x<TAB>y` found similar and
    found different, and what an unjudged pair is."""
    by_word: dict[str, int] = {}
    by_number: dict[float, int] = {}
    numbers = 0
    parts = []
    for i, text in enumerate(texts):
        parts.append([w for w in _PARTS.split(text) if w])
        for w in parts[i]:
            by_word[w] = by_word.get(w, 0) | 1 << i
        if nums[i] is not None:
            numbers |= 1 << i
            if nums[i] == nums[i]:
                by_number[nums[i]] = by_number.get(nums[i], 0) | 1 << i
    bits = [1 << i for i in range(len(texts))]
    for i, text in enumerate(texts):
        for w in parts[i]:
            bits[i] |= by_word[w]
    by_size = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at, i in enumerate(by_size):
        text = texts[i]
        for j in by_size[at + 1 :]:
            if text in texts[j]:
                bits[i] |= 1 << j
                bits[j] |= 1 << i
    for i, x in enumerate(nums):
        if x is not None:
            bits[i] = bits[i] & ~numbers | by_number.get(x, 0)
    if judged is not None:
        alike, apart, unjudged = judged
        for i, x in enumerate(texts):
            for j in range(i + 1):
                typed = (nums[i] is not None and nums[j] is not None) or forms[i] & forms[j] & (_TIME | _DATE)
                if typed or bits[i] >> j & 1:
                    continue
                pair = "\t".join(sorted((x, texts[j])))
                if pair in alike or (pair not in apart and unjudged):
                    bits[i] |= 1 << j
                    bits[j] |= 1 << i
    return bits


def _fold(known: bool, items: list[tuple], judged: tuple[set[str], set[str], bool] | None) -> Iterator[tuple]:
    """(country, question, answers, chosen) of a question's countries. items:
    country, question, format asked for, answer, votes, pos, country_ord, whether
    the country is listed, num, formats the answer has."""
    at: dict[str, int] = {}
    nums, forms = [], []
    own: dict[tuple, list[tuple]] = {}
    for item in items:
        if item[3] not in at:
            at[item[3]] = len(at)
            nums.append(item[8])
            forms.append(item[9])
        own.setdefault(item[:3], []).append(item)
    bits = _alike(list(at), nums, forms, judged)
    # A question without an id is nobody else's.
    able = [c for c in items if known and c[7] and c[4] is not None and c[4] >= MIN_VOTES]
    able.sort(key=lambda c: (-c[4], _least_first(c[6]), _least_first(c[5]), c[0], c[3]))
    cands = [(c[0], c[3], 1 << at[c[3]], bits[at[c[3]]], c[9]) for c in able]
    for (country, question, asked), mine in own.items():
        most = max((m[4] for m in mine if m[4] is not None), default=None)
        mine = sorted((m for m in mine if m[9] >> asked & 1), key=lambda m: (_least_first(m[5]), m[3], _least_first(m[4])))
        held, blocked, taken, chosen = 0, 0, {country}, []
        for m in mine:
            held |= 1 << at[m[3]]
        for c_country, answer, bit, like, form in cands:
            if c_country in taken or blocked & bit or not form >> asked & 1:
                continue
            if like & held:
                blocked |= bit
            else:
                chosen.append((c_country, answer))
                taken.add(c_country)
                held |= bit
        yield country, question, [m[3] for m in mine if most is not None and m[4] == most], chosen


def _parts(df: DataFrame) -> int:
    """As many parts as shuffles have. Named, as adaptive execution would merge
    rows that are few and small, but cost much, into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lists(rows: list[list], kind: pa.DataType, make: object) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(ends, make([x for r in rows for x in r], kind))


def distractors(reps: DataFrame, countries: DataFrame, judged: DataFrame | None = None, unjudged: bool = True) -> DataFrame:
    """(country, qid, question, answers, choices): for each country at most one
    answer of every other country, chosen greedily: of those with enough votes,
    most votes first, then by country and place, each that is not like any own
    answer, nor like one chosen before. judged: qid, a, b and is_similar of pairs
    that were judged; with it a pair that is not settled by text, by format or by
    a judgement counts as `unjudged`. Without a table text alone decides."""
    order = F.broadcast(countries.groupBy("country").agg(F.min("country_ord").cast("bigint").alias("ord"), F.lit(True).alias("listed")))  # fixed, 16 rows
    asked = F.lit(len(_FORMATS) - 1)
    for i in reversed(range(len(_FORMATS) - 1)):
        asked = F.when(F.col("question").contains(_FORMATS[i]), i).otherwise(asked)
    forms = sum((F.when(T.fits_question(F.col("answer"), F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(_FORMATS)), F.lit(0))
    item = F.struct("country", "question", asked.alias("asked"), "answer", F.col("votes").cast("bigint").alias("votes"), F.col("pos").cast("bigint").alias("pos"), "ord", F.coalesce("listed", F.lit(False)).alias("listed"), T.number(F.col("answer")).alias("num"), forms.alias("forms"))
    with_judge = judged is not None
    rows = reps.join(order, "country", "left").groupBy("qid").agg(F.collect_list(item).alias("items"))
    if with_judge:
        pair = F.concat_ws("\t", F.least("a", "b"), F.greatest("a", "b"))
        found = judged.groupBy("qid").agg(F.collect_set(F.when(F.col("is_similar"), pair)).alias("alike"), F.collect_set(F.when(~F.col("is_similar"), pair)).alias("apart"))
        rows = rows.join(found, "qid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(start, _BATCH)
                held, out = batch.column(1), []
                items = list(zip(*(c.to_pylist() for c in held.flatten().flatten()), strict=True))
                ends = np.cumsum([0, *held.value_lengths().to_pylist()])
                pairs = [(set(a or ()), set(b or ()), unjudged) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)] if with_judge else [None] * len(held)
                for i, qid in enumerate(batch.column(0).to_pylist()):
                    out += [(country, qid, *rest) for country, *rest in _fold(qid is not None, items[ends[i] : ends[i + 1]], pairs[i])]
                country, qid, question, answers, chosen = map(list, zip(*out, strict=True)) if out else ([],) * 5
                both = lambda x, _: pa.StructArray.from_arrays([pa.array([c for c, _ in x], pa.string()), pa.array([a for _, a in x], pa.string())], ["country", "answer"])
                yield pa.RecordBatch.from_arrays([pa.array(country, pa.string()), pa.array(qid, pa.string()), pa.array(question, pa.string()), _lists(answers, pa.string(), pa.array), _lists(chosen, None, both)], names=["country", "qid", "question", "answers", "choices"])

    return rows.mapInArrow(run, _CHOSEN)


def combinations(items: Column, m: Column) -> Column:
    """All choices of m items (0 to 3) in their order, as arrays."""
    n = F.size(items)
    pick = lambda i: F.get(items, i)
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    one = F.transform(items, lambda x: F.array(x))
    two = F.flatten(F.transform(upto(F.lit(0), n - 2), lambda i: F.transform(upto(i + 1, n - 1), lambda j: F.array(pick(i), pick(j)))))
    three = F.flatten(F.transform(upto(F.lit(0), n - 3), lambda i: F.flatten(F.transform(upto(i + 1, n - 2), lambda j: F.transform(upto(j + 1, n - 1), lambda k: F.array(pick(i), pick(j), pick(k)))))))
    return F.when(m == 0, F.array(F.slice(items, 1, 0))).when(m == 1, one).when(m == 2, two).otherwise(three)


def _ways(n: Column, m: Column) -> Column:
    """In how many ways m (0 to 3) of n can be chosen."""
    return F.when(m == 0, 1).when(m == 1, n).when(m == 2, (n * (n - 1) / 2).cast("int")).otherwise((n * (n - 1) * (n - 2) / 6).cast("int"))


def fillers(options: DataFrame, reps: DataFrame) -> DataFrame:
    """(qid, option): filler options that may be used, in lower case. Null and
    blank ones, and those that are an annotated answer of any country as it is
    written, are none; repeated ones count once."""
    given = options.where("option is not null and trim(option) <> ''").select("qid", "option").distinct()
    return given.join(reps.select("qid", F.col("answer").alias("option")).distinct(), ["qid", "option"], "left_anti").select("qid", F.lower("option").alias("option")).distinct()


def unfinished(qids: DataFrame, held: DataFrame, countries: DataFrame) -> DataFrame:
    """Questions whose last country, in the countries' order, is not held yet:
    those a resumed run has to do again. qids: qid; held: country, qid."""
    last = countries.agg(F.max_by("country", "country_ord").alias("country"))  # one row
    return qids.select("qid").distinct().join(held.join(F.broadcast(last), "country", "left_semi").select("qid").distinct(), "qid", "left_anti")


def encoded(questions: DataFrame) -> DataFrame:
    """Multiple-choice questions as a file holds them: choices as JSON text."""
    return questions.withColumn("choices", F.to_json("choices")).withColumn("choice_countries", F.to_json("choice_countries"))


#: Rows a part of the exploded questions should have.
PART_ROWS = 20_000


_LETTERS = "ABCD"


def _arranged(chosen: DataFrame, countries: DataFrame, dummies: DataFrame | None, all_countries: bool) -> DataFrame:
    """A row per multiple-choice question: its number, and the places o0 to o3 of
    its options among all of the answer's (texts `vs`, countries `ks`), in order.
    json: the texts as JSON values, in order; ranks: where each text is in it."""
    question = Window.partitionBy("qid")  # a row per country
    rows = chosen.withColumn("m", F.least(F.min(F.size("choices")).over(question), F.lit(OPTIONS)))
    if all_countries:
        every = countries.agg(F.count(F.lit(1)).alias("_every"))  # one row
        rows = rows.withColumn("_held", F.count(F.lit(1)).over(question)).crossJoin(F.broadcast(every)).withColumn("m", F.when(F.col("_held") < F.col("_every"), 0).otherwise(F.col("m")))
    option = "struct<v:string,k:string>"
    if dummies is None:
        rows = rows.where(F.col("m") >= OPTIONS).withColumn("extra", F.array().cast(f"array<{option}>"))
    else:
        held = dummies.groupBy("qid").agg(F.array_sort(F.collect_set("option")).alias("options"))
        rows = rows.join(held, "qid", "left").withColumn("extra", F.transform(F.slice(F.coalesce("options", F.array().cast("array<string>")), F.lit(1), F.greatest(F.lit(OPTIONS) - F.col("m"), F.lit(0))), lambda o: F.struct(o.alias("v"), F.lit("dummy").alias("k")))).where(F.col("m") + F.size("extra") >= OPTIONS)
    order = F.broadcast(countries.select("country", "country_ord"))
    rows = rows.join(order, "country").withColumn("n", F.size("choices")).withColumn("ways", _ways(F.col("n"), F.col("m")))
    # Numbers run over countries, answers and choices; they follow from the sizes, so nothing is sorted after the explosion.
    before = Window.partitionBy("qid").orderBy("country_ord").rowsBetween(Window.unboundedPreceding, -1)
    many = F.size("answers") * F.col("ways")
    rows = rows.withColumn("base", F.coalesce(F.sum(many).over(before), F.lit(0)))
    # A row becomes hundreds: spread first, by salts in proportion to what becomes
    # of a row's question, so that parts are of one size whatever their number.
    rows = rows.withColumn("_salt", F.floor(F.col("base") / F.lit(PART_ROWS)) + F.floor(many / F.lit(PART_ROWS))).repartition(_parts(rows), "qid", "country", "_salt").drop("_salt")
    # All that does not differ between choices of distractors is made once an answer:
    # the question's text, and the options in order with the place of each in it.
    head = F.concat(name_country_always(F.col("question"), F.col("country")), F.lit(INSTRUCTION))
    others = F.concat(F.transform("choices", lambda c: F.struct(c["answer"], c["country"])).cast(f"array<{option}>"), F.col("extra").cast(f"array<{option}>"))
    rows = rows.select("qid", "country", head.alias("head"), "n", "m", "ways", "base", others.alias("others"), F.posexplode("answers").alias("answer_pos", "answer"))
    own = F.struct("answer", "country").cast(option)
    rows = rows.withColumn("own", own).withColumn("sorted", F.array_sort(F.concat("others", F.array("own"))))
    # How many choices follow all those with a distractor at its place.
    behind = lambda t: F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when((i < F.col("n")) & (F.col("m") > t), _ways(F.col("n") - 1 - i, F.col("m") - t)).otherwise(0))
    place = lambda o: (F.array_position("sorted", o) - 1).cast("int")
    rows = rows.select("qid", "country", "answer", "head", "n", "m", (F.col("base") + (F.col("answer_pos") + 1) * F.col("ways") - 1).alias("number"), F.transform("others", place).alias("places"), place(F.col("own")).alias("p3"), *(behind(t).alias(f"behind{t}") for t in range(OPTIONS)), F.col("sorted")["v"].alias("vs"), F.col("sorted")["k"].alias("ks"))
    rows = rows.withColumn("_json", F.transform("vs", lambda v: F.to_json(F.create_map(F.lit("A"), v)))).withColumn("json", F.array_sort(F.array_distinct("_json")))
    rows = rows.withColumn("ranks", F.transform("_json", lambda j: F.array_position("json", j) - 1)).drop("_json")
    # One distractor after the other; fillers stand after the distractors.
    kept = rows.columns
    for t in range(OPTIONS):
        left = F.col("m") - t
        first = F.col(f"i{t - 1}") + 1 if t else F.lit(0)
        pick = F.when(left > 0, F.sequence(first, F.col("n") - left)).otherwise(F.array(F.col("n") - left))
        rows = rows.select(*kept, *(f"i{u}" for u in range(t)), F.explode(pick).alias(f"i{t}"))
    after = sum((F.coalesce(F.get(f"behind{t}", F.col(f"i{t}")), F.lit(0)) for t in range(OPTIONS)), F.lit(0))
    kept = ["qid", "country", "answer", "head", "vs", "ks", "json", "ranks", "number"]
    rows = rows.select(*kept[:-1], (F.col("number") - after).alias("number"), *(F.get("places", F.col(f"i{t}")).alias(f"p{t}") for t in range(OPTIONS)), "p3")
    # The four options in order.
    rows = rows.select(*kept, F.least("p0", "p1").alias("a"), F.greatest("p0", "p1").alias("b"), F.least("p2", "p3").alias("c"), F.greatest("p2", "p3").alias("d"))
    rows = rows.select(*kept, F.least("a", "c").alias("o0"), F.greatest("a", "c").alias("x"), F.least("b", "d").alias("y"), F.greatest("b", "d").alias("o3"))
    return rows.select(*kept, "o0", F.least("x", "y").alias("o1"), F.greatest("x", "y").alias("o2"), "o3")


def _each(array: str) -> list[Column]:
    """Of an array by place what belongs to each of the four options."""
    return [F.get(array, F.col(f"o{i}")).alias(f"{array}{i}") for i in range(len(_LETTERS))]


def _named() -> Column:
    """The letter of the last option equal to the answer."""
    return F.coalesce(*(F.when(F.col(f"vs{i}") == F.col("answer"), F.lit(x)) for i, x in reversed([*enumerate(_LETTERS)])))


def assemble(chosen: DataFrame, countries: DataFrame, dummies: DataFrame | None = None, all_countries: bool = True) -> DataFrame:
    """Multiple-choice questions: for every top answer and every choice of m
    distractors, m the fewest any country has but three at most; dummies (qid,
    option; see `fillers`) fill up to three. With `all_countries` a country
    without the question counts as having none. A question short of options is
    left out."""
    rows = _arranged(chosen, countries, dummies, all_countries).select("qid", "country", "answer", "head", "number", *_each("vs"), *_each("ks"))
    prompt = F.concat("head", *(x for i, a in enumerate(_LETTERS) for x in (F.lit(f"{a}. "), F.col(f"vs{i}"), F.lit("\n"))), F.lit("\nAnswer:"))
    entries = lambda f: F.create_map(*(x for i, a in enumerate(_LETTERS) for x in (F.lit(a), F.col(f"{f}{i}"))))
    return rows.select(F.concat_ws("_", "qid", "number").alias("MCQID"), F.col("qid").alias("ID"), "country", prompt.alias("prompt"), entries("vs").alias("choices"), entries("ks").alias("choice_countries"), _named().alias("answer_idx"))


#: Digits that numbers of questions are filled up to, where they are compared as text.
_DIGITS = 12
#: Options of an answer that a comparison tells apart.
_BASE = 1 << 12


def letters(chosen: DataFrame, countries: DataFrame, dummies: DataFrame | None = None, all_countries: bool = True) -> DataFrame:
    """(ID, country, answer_idx, n, first_id, last_choices): how many questions of
    `assemble` have their answer at a letter, the least MCQID and the greatest
    choices as JSON, both as texts. All questions are gone through; texts are
    compared by numbers in the same order, so that sums by hash suffice and
    nothing is sorted: the number with its digits at the left, and the options'
    places among the answer's options as JSON (no JSON text begins another)."""
    rows = _arranged(chosen, countries, dummies, all_countries).select("qid", "country", "answer", "json", "number", *_each("vs"), *_each("ranks"))
    digits = F.length(F.col("number").cast("string"))
    tens = F.array(*(F.lit(10**i).cast("bigint") for i in range(_DIGITS + 1)))
    rows = rows.select("qid", "country", "json", "number", digits.alias("digits"), F.col("ranks0").alias("code"), "ranks1", "ranks2", "ranks3", _named().alias("letter"))
    code = F.col("code")
    for i in range(1, len(_LETTERS)):
        code = code * _BASE + F.col(f"ranks{i}")
    rows = rows.select("qid", "country", "json", "letter", (F.col("number") * F.get(tens, _DIGITS - F.col("digits")) * 16 + F.col("digits")).alias("place"), code.alias("code"))
    rows = rows.groupBy("qid", "country", "json", "letter").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.max("code").alias("code"))
    text = lambda i: F.get("json", F.shiftright("code", 12 * (len(_LETTERS) - 1 - i)).bitwiseAND(_BASE - 1).cast("int"))
    value = lambda t: F.substring(t, F.lit(6), F.length(t) - 6)  # noqa: E731  {"A":value}
    parts = [x for i, a in enumerate(_LETTERS) for x in (F.lit(f'{"," if i else "{"}"{a}":'), value(text(i)))]
    number = F.substring(F.lpad(F.shiftright("place", 4).cast("string"), _DIGITS, "0"), F.lit(1), F.col("place").bitwiseAND(15).cast("int"))
    rows = rows.select(F.col("qid").alias("ID"), "country", F.col("letter").alias("answer_idx"), "n", F.concat_ws("_", "qid", number).alias("first_id"), F.concat(*parts, F.lit("}")).alias("last_choices"))
    return rows.groupBy("ID", "country", "answer_idx").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_choices").alias("last_choices"))
