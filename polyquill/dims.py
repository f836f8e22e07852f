"""Fixed dimensions: countries with their languages, and provider routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Country, language in the order that breaks ties, ISO and language codes.
COUNTRIES = [
    ("UK", "English", "GB", "en"), ("US", "English", "US", "en"), ("South_Korea", "Korean", "KR", "ko"), ("Algeria", "Arabic", "DZ", "ar"),
    ("China", "Chinese", "CN", "zh"), ("Indonesia", "Indonesian", "ID", "id"), ("Spain", "Spanish", "ES", "es"), ("Iran", "Persian", "IR", "fa"),
    ("Mexico", "Spanish", "MX", "es"), ("Assam", "Assamese", "AS", "as"), ("Greece", "Greek", "GR", "el"), ("Ethiopia", "Amharic", "ET", "am"),
    ("Northern_Nigeria", "Hausa", "NG", "ha"), ("Azerbaijan", "Azerbaijani", "AZ", "az"), ("North_Korea", "Korean", "KP", "ko"), ("West_Java", "Sundanese", "JB", "su"),
]
#: The first of these that a model's name contains names its provider.
PROVIDERS = [("gpt", "azure"), ("gemini", "gemini"), ("bison", "vertex"), ("claude", "claude"), ("command", "cohere"), ("Qwen", "together")]


def countries(spark: SparkSession) -> DataFrame:
    """16 rows: country, language, iso, lang_code, country_ord."""
    rows = [(c, lang, iso, code, i) for i, (c, lang, iso, code) in enumerate(COUNTRIES)]
    return spark.createDataFrame(rows, "country string, language string, iso string, lang_code string, country_ord int")


def provider(model: Column) -> Column:
    """Provider of a model name; local without a match, null for null."""
    out = F.when(model.isNull(), F.lit(None).cast("string"))
    for part, name in PROVIDERS:
        out = out.when(model.contains(part), name)
    return out.otherwise("local")
