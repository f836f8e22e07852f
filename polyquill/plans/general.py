"""Queries of the general data operators: nested records and drifting files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyquill.operators import drift, nested
from polyquill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.annotation_nodes(table(spark, sf_dir, "annotation_files"))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridge(table(spark, sf_dir, "annotation_files"))


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nodes(table(spark, sf_dir, "annotation_files"))


def p4_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that give no rows, with the reason."""
    return nested.unreadable(table(spark, sf_dir, "annotation_files")).select("file_id", "reason")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "prompt_files"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.promote(drift.ingest(table(spark, sf_dir, "prompt_files")))


QUERIES: dict[str, Query] = {"p4_found": p4_found, "p4_bridge": p4_bridge, "p4_nodes": p4_nodes, "p4_unreadable": p4_unreadable, "p5_found": p5_found, "p5_table": p5_table}
_RECORDS = """WITH f AS (SELECT row_number() OVER () AS rid, file_id, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM (SELECT file_id, regexp_replace(payload, '^\\x{FEFF}', '') AS p FROM annotation_files)),
o AS (SELECT rid, file_id, t, key, pos AS i, value AS rec FROM (SELECT f.rid, f.file_id, json_type(f.j) AS t, x.key, x.value, x.id AS pos FROM f, json_each(f.j) AS x WHERE json_type(f.j) IN ('OBJECT', 'ARRAY'))),
k AS (SELECT rid, file_id, i, rec, CASE t WHEN 'OBJECT' THEN key WHEN 'ARRAY' THEN CASE WHEN json_type(rec) = 'OBJECT' THEN coalesce(rec ->> '$.ID', rec ->> '$.id', rec ->> '$.qid', rec ->> '$.question_id') END END AS qid FROM o),
r AS (SELECT * FROM k WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid, qid ORDER BY i DESC) = 1)"""
_ITEMS = "CASE WHEN json_type({x}) = 'ARRAY' THEN {x} WHEN coalesce(json_type({x}), 'NULL') <> 'NULL' THEN json_array({x}) END"

SQL: dict[str, str] = {
    "p4_unreadable": _RECORDS + """,
u AS (SELECT row_number() OVER () AS rid, payload FROM annotation_files)
SELECT file_id, CASE WHEN payload IS NULL OR trim(payload, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN j IS NULL THEN 'invalid JSON' ELSE 'no record' END AS reason
FROM f JOIN u USING (rid) WHERE rid NOT IN (SELECT rid FROM r WHERE json_type(rec) = 'OBJECT')""",
    "p4_found": _RECORDS + f""",
l AS (SELECT rid, file_id, qid, unnest([{_ITEMS.format(x="(rec -> '$.annotations')")}, {_ITEMS.format(x="(rec -> '$.aggregated_answers')")}]) AS gs FROM r WHERE json_type(rec) = 'OBJECT'),
g AS (SELECT l.rid, file_id, qid, x.key::INT AS grp, x.value AS g FROM l, json_each(l.gs) AS x WHERE gs IS NOT NULL AND json_type(x.value) = 'OBJECT'),
m AS (SELECT file_id, qid, grp, unnest([{{'n': 'answer', 'v': {_ITEMS.format(x="(g -> '$.answers')")}}}, {{'n': 'en_answer', 'v': {_ITEMS.format(x="(g -> '$.en_answers')")}}}, {{'n': 'vote', 'v': {_ITEMS.format(x="(g -> '$.votes')")}}}]) AS f FROM g)
SELECT file_id, qid, 'group' AS node, grp, '' AS item FROM g
UNION ALL SELECT file_id, qid, f.n, grp, x.key FROM m, json_each(m.f.v) AS x WHERE f.v IS NOT NULL AND json_type(x.value) <> 'NULL'
UNION ALL SELECT file_id, qid, 'idk', -1, unnest(json_keys(rec -> '$.idks')) FROM r WHERE json_type(rec) = 'OBJECT' AND json_type(rec -> '$.idks') = 'OBJECT'""",
}
