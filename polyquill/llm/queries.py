"""Queries of the operators for training text, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquill.llm import bpe, lookalikes, mixing, pairs, pii, terms
from polyquill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotations = table(spark, sf_dir, "annotations")
    found = terms.counts(terms.annotation_records(annotations), "values")
    total = annotations.select("country", "qid").distinct().agg(F.count(F.lit(1)).alias("n_records"))
    return terms.mark_terms(found, total).where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its numbers, marked or not."""
    found = terms.counts(terms.annotation_records(table(spark, sf_dir, "annotations")), "values")
    return found.select("term", "occurrences", "records")


def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams within values."""
    found = terms.counts(terms.annotation_records(table(spark, sf_dir, "annotations")), "values", max_n=None)
    return found.where("n > 0").select(F.col("term").alias("ngram"), "n", "occurrences", "records")


_VALUES = r"""
WITH last AS (
  SELECT country, qid, annotations FROM annotations
  QUALIFY row_number() OVER (PARTITION BY country, qid ORDER BY loaded_at DESC NULLS LAST, ann_id DESC NULLS LAST) = 1),
grp AS (SELECT country, qid, unnest(annotations) AS g FROM last),
val AS (SELECT country, qid, unnest(g.en_answers) AS v FROM grp WHERE g IS NOT NULL),
term AS (
  SELECT country, qid, trim(regexp_replace(lower(v), '\s+', ' ', 'g')) AS term FROM val
  WHERE trim(regexp_replace(lower(v), '\s+', ' ', 'g')) <> ''),
n AS (SELECT count(*) AS n_records FROM last)
"""

SQL: dict[str, str] = {
    "p1_found": _VALUES + """
SELECT term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark
FROM (SELECT term, count(DISTINCT (country, qid)) AS records FROM term GROUP BY term), n
WHERE records < 3 OR records > 0.02 * n_records""",
    "p1_terms": _VALUES + "SELECT term, count(*) AS occurrences, count(DISTINCT (country, qid)) AS records FROM term GROUP BY term",
    "p1_ngrams": _VALUES + """,
w AS (SELECT country, qid, string_split(term, ' ') AS words FROM term),
k AS (SELECT country, qid, words, unnest([1, 2, 3]) AS n FROM w),
s AS (SELECT country, qid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM k WHERE len(words) >= n),
g AS (SELECT country, qid, n, array_to_string(words[i:i + n - 1], ' ') AS ngram FROM s)
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT (country, qid)) AS records FROM g GROUP BY ngram, n""",
}


def _languages(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The languages of the fixed table of 16 countries."""
    return tuple(sorted({r.language for r in table(spark, sf_dir, "countries").select("language").collect() if r.language}))


def _lookalike_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lookalikes.Rewriter]:
    countries = table(spark, sf_dir, "countries")
    answers = lookalikes.answer_texts(table(spark, sf_dir, "annotations"), countries)
    texts = answers.unionByName(lookalikes.response_texts(table(spark, sf_dir, "model_inference_results")))
    return texts, lookalikes.learn(texts, _languages(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, rewriter = _lookalike_texts(spark, sf_dir)
    return lookalikes.rewrite(texts, rewriter, changed_only=True).select("origin", "rec_id", "grp", "item").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    texts, rewriter = _lookalike_texts(spark, sf_dir)
    return lookalikes.rewrite(texts, rewriter)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "model_inference_results"), _languages(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document back from its ids: the texts themselves."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"), pii.learn(table(spark, sf_dir, "name_lexicon")))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"), pii.learn(table(spark, sf_dir, "name_lexicon")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = bpe.token_counts(documents).withColumn("sources", F.array_compact(F.array("source")))
    return mixing.mix(counted, table(spark, sf_dir, "mix_targets"))


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with equal texts as one record that lies in all sources it came
    from, so that patterns overlap; doc_id is the least of the text's."""
    documents = table(spark, sf_dir, "documents").where("text is not null")
    records = documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("sources"))
    return mixing.mix(bpe.token_counts(records), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


SQL["p6_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_terms": p1_terms, "p1_ngrams": p1_ngrams, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_overlap": p7_overlap, "p8_found": p8_found, "p8_redacted": p8_redacted}
