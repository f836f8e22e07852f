"""Readers and writers of the benchmark's file formats, with explicit schemas.

Missing-value words become nulls, as the first readers of these files made them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Words read as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
ANNOTATION = "map<string,struct<question:string,en_question:string,{key}:array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>,idks:map<string,bigint>>>"


def _file_part(pattern: str, group: int) -> Column:
    return F.regexp_extract(F.input_file_name(), pattern, group)


def read_csv(spark: SparkSession, path: str | list[str], missing: bool = True) -> DataFrame:
    """Delimited files with line breaks and doubled quotes in cells, all columns
    as strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if missing:
        df = df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))
    return df


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """{country}_prompts.csv: country, prompt_ord, id, english, translation."""
    df = read_csv(spark, path, missing=False).withColumn("country", _file_part(r"([^/]+)_prompts\.csv", 1))
    return df.select("country", F.monotonically_increasing_id().alias("prompt_ord"), "id", F.col("English").alias("english"), F.col("Translation").alias("translation"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """{country}_questions.csv with the country of each file."""
    return read_csv(spark, path).withColumn("country", F.regexp_replace(_file_part(r"([^/]+?)(?:_full_final|_final)?_questions\.csv", 1), " ", "_"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """{model}-{country}_{language}_{prompt}_result.csv with the four parts."""
    df = read_csv(spark, path)
    pattern = r"([^/]+)-([A-Za-z_]+)_([A-Za-z]+)_([A-Za-z]+-\d+|None)_result\.csv"
    return df.select("*", *(_file_part(pattern, i).alias(c) for i, c in enumerate(("model", "country", "language", "file_prompt_no"), 1)))


def read_annotations(spark: SparkSession, path: str, key: str = "annotations") -> DataFrame:
    """{country}_data.json, one object by question id: one row a question."""
    text = spark.read.text(path, wholetext=True).withColumn("country", _file_part(r"([^/]+)_data(?:_aggregated)?\.json", 1))
    rows = text.select("country", F.explode(F.from_json("value", ANNOTATION.format(key=key))).alias("qid", "r"))
    return rows.select("country", "qid", "r.question", "r.en_question", F.col(f"r.{key}").alias("annotations"), "r.idks")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """A file of multiple-choice questions: choices and choice_countries come
    back as maps; text that is no JSON object gives null."""
    df = read_csv(spark, path, missing=False)
    back = lambda c: F.from_json(c, "map<string,string>").alias(c)
    return df.select(*(back(c) if c in ("choices", "choice_countries") else F.col(f"`{c}`") for c in df.columns))


def read_template(path: str) -> dict[str, str]:
    """An instruction template: a small JSON file read on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append", watch: Observation | None = None) -> None:
    """Parquet, partitioned by run so that readers prune by file. With `watch`
    the rows written are counted on the way (watch.get["rows"])."""
    writer = (df if watch is None else df.observe(watch, F.count(F.lit(1)).alias("rows"))).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"', quoteAll=False)
