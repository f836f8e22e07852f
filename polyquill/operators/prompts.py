"""Prompts: which to use, how to fill them in, and what is left to ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquill.operators.latest import keep_first, missing_from


def question_column(language: str | Column, native: Column, question: Column, translation: Column) -> Column:
    """The text of a question in a language: its translation in the country's
    own language, else the English question, else null."""
    language = F.lit(language) if isinstance(language, str) else language
    return F.when(language == native, translation).when(language == "English", question)


def render(template: Column, question: Column) -> Column:
    """All places of {q} filled in."""
    return F.replace(template, F.lit("{q}"), question)


def name_country(text: Column, country: Column, language: Column, native: Column) -> Column:
    """`your country` by name, where an English question goes to a country
    with another language."""
    named = F.replace(text, F.lit("your country"), F.replace(country, F.lit("_"), F.lit(" ")))
    return F.when((language == "English") & (native != "English"), named).otherwise(text)


def name_country_always(text: Column, country: Column) -> Column:
    """`your country` by name in every case, with the article of the US and the UK."""
    name = F.when(country.isin("US", "UK"), F.concat(F.lit("the "), country)).otherwise(F.replace(country, F.lit("_"), F.lit(" ")))
    return F.replace(text, F.lit("your country"), name)


def first_prompts(prompts: DataFrame) -> DataFrame:
    """Of a prompt id given twice in a country the first stands. Takes country,
    prompt_ord, id and the texts."""
    return keep_first(prompts, ["country", "id"], ["prompt_ord"])


def matrix(models: DataFrame, countries: DataFrame, prompt_ids: DataFrame) -> DataFrame:
    """Every run: model x country x prompt in the country's language, and in
    English where that is another one. The dimensions are small and fixed."""
    base = models.select("model").distinct().crossJoin(F.broadcast(countries.select("country", F.col("language").alias("native")))).crossJoin(F.broadcast(prompt_ids.select("prompt_no").distinct()))
    legs = F.when(F.col("native") == "English", F.array(F.col("native"))).otherwise(F.array(F.col("native"), F.lit("English")))
    return base.select("model", "country", "prompt_no", F.explode(legs).alias("language"))


def inference(runs: DataFrame, questions: DataFrame, countries: DataFrame, prompts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """All prompts to send: runs x their country's questions, rendered; those
    already answered are left out. prompts: country, id, english, translation."""
    native = countries.select(F.col("country"), F.col("language").alias("native"))
    asked = runs.join(F.broadcast(native), "country").join(questions.select("country", "id", "question", "translation"), "country")
    text = question_column(F.col("language"), F.col("native"), F.col("question"), F.col("translation"))
    asked = asked.withColumn("question", name_country(text, F.col("country"), F.col("language"), F.col("native"))).drop("translation")
    sheets = first_prompts(prompts).select("country", F.col("id").alias("prompt_no"), F.col("english").alias("_en"), F.col("translation").alias("_tr"))
    asked = asked.join(sheets, ["country", "prompt_no"])
    template = F.when(F.col("language") == "English", F.col("_en")).otherwise(F.col("_tr"))
    out = asked.select("model", "country", "language", "prompt_no", "id", "question", render(template, F.col("question")).alias("prompt"))
    return out if done is None else missing_from(out, done, ["model", "country", "language", "prompt_no", "id"])


def pairs(languages: list[str], countries: list[str]) -> list[tuple[str, str]]:
    """Languages and countries one by one; their numbers must agree."""
    if len(languages) != len(countries):
        raise ValueError("as many languages as countries are needed")
    return list(zip(languages, countries, strict=True))


def fill_template(template: dict[str, str], instruction: Column, given: Column | None = None, label: Column | None = None) -> Column:
    """A prompt from an instruction template: `prompt_input` where an input is
    given (null and empty ones are not), else `prompt_no_input`; a label follows."""
    bare = F.replace(F.lit(template["prompt_no_input"]), F.lit("{instruction}"), instruction)
    out = bare
    if given is not None:
        full = F.replace(F.replace(F.lit(template["prompt_input"]), F.lit("{instruction}"), instruction), F.lit("{input}"), given)
        out = F.when(F.coalesce(given, F.lit("")) != "", full).otherwise(bare)
    return out if label is None else F.concat(out, F.coalesce(label, F.lit("")))


def template_response(template: dict[str, str], output: Column) -> Column:
    """What follows the template's response marker, to the next one; null without it."""
    return F.trim(F.get(F.split(output, "\\Q" + template["response_split"] + "\\E"), F.lit(1)))
