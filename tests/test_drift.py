import json

import pytest
from polyquill.operators import drift
from pyspark.sql import functions as F

HEAD = "id,English,Edited\n"


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, sheet_id bigint, version_no int, file_name string, file_text string")


def changes(spark, *texts, names=None):
    rows = [(i + 1, 1, i + 1, (names or {}).get(i, "a.csv"), t) for i, t in enumerate(texts)]
    return {tuple(r) for r in drift.changes(frame(spark, rows)).collect()}


def test_changes(spark):
    v1 = 'id,English,Edited Y/N\ninst-1,"a\nb",Y\ninst-2,c,N\n'
    assert changes(spark, v1, '﻿"id"," English ","Edited"\r\n"inst-2","c","N"\r\n"inst-1","a\r\nb","Y"\r\n') == {(2, "renamed", "Edited")}
    assert changes(spark, v1, "prompt_id\tEnglish\tEdited Y/N\ninst-2\tc\t3\n", names={1: "b.tsv"}) == {(2, "renamed", "prompt_id"), (2, "retyped", "Edited Y/N")}
    assert changes(spark, v1, "id,English\ninst-1,other\n") == {(2, "removed", "Edited Y/N")}
    assert changes(spark, "id,English\ninst-1,x\n", "id,English,New\ninst-1,x,\n") == {(2, "added", "New")}
    assert changes(spark, HEAD + "inst-1,x,Y\n", HEAD + "inst-1,x,\n") == set()
    assert changes(spark, HEAD + "inst-1,x,2024-01-02\n", HEAD + "inst-1,x,03 Jan 2025\n") == set()
    # Nulls and blank files are no versions: the one before is compared.
    assert changes(spark, HEAD + "inst-1,x,Y\n", None, "  \n", HEAD + "inst-1,x,7\n") == {(4, "retyped", "Edited")}


def test_changes_come_from_ingested_rows(spark, monkeypatch):
    texts = ["id,English,Native,Edited Y/N,x\ninst-1,a,b,Y, \ninst-2,c,d,N,\n", "id,English,Local Translation,Edited,x\ninst-1,a,b,Y, ,over\ninst-2,c,d,N,,\n", "id,English\n"]
    want = {(2, "renamed", "Local Translation"), (2, "renamed", "Edited"), *((3, "removed", n) for n in ("Local Translation", "Edited", "x"))}
    # Whatever the target schema takes or leaves to _rescued, the report is the same.
    for aliases in ({}, {"english": ("Edited",), "translation": ("x",)}, drift.PROMPT_SCHEMA.aliases):
        schema = drift.TargetSchema(drift.PROMPT_SCHEMA.columns, aliases)
        assert {tuple(r) for r in drift.changes(frame(spark, [(i + 1, 1, i + 1, "a.csv", t) for i, t in enumerate(texts)]), schema).collect()} == want
    # A cell of blanks is no empty cell here.
    assert changes(spark, "id,x\ninst-1, \ninst-2,a\n", "id,y\ninst-1,\ninst-2,a\n") == {(2, "added", "y"), (2, "removed", "x")}
    used = []
    whole = drift.ingest_files
    monkeypatch.setattr(drift, "ingest_files", lambda *a, **k: used.append(1) or whole(*a, **k))
    assert changes(spark, *texts) == want and used


def test_rows_over_many_batches(spark):
    rows = [(i, i // 2, i % 2, "a.csv", "id,English,%s\n" % ("xy"[i % 2]) + "".join(f"inst-{k},e{k},{i // 2}v{k}\n" for k in range(20))) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in drift.changes(frame(spark, rows)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, "renamed", "y") for i in range(1, 60, 2)]


def test_names_stay_apart(spark):
    rows = [(1, 1, 1, "a.csv", "id,a#2,a,a,_extra\ninst-1,p,q,r,s,t\n")]
    got = drift.ingest(frame(spark, rows)).first()._rescued
    assert got == '{"a#2": "p", "a": "q", "a#3": "r", "_extra": "s", "_extra_": ["t"]}'


def test_versions_left_out_and_sent_again(spark):
    a, b = HEAD + "inst-1,x,Y\n", "id,English\ninst-1,x\n"
    rows = [(10, 1, 1, "a.csv", a), (11, 1, 700, "a.csv", b), (12, 1, 700, "a.csv", a), (13, None, 1, "a.csv", a), (14, 1, None, "a.csv", b)]
    assert {tuple(r) for r in drift.changes(frame(spark, rows)).collect()} == {(11, "removed", "Edited")}


def test_empty(spark):
    assert drift.changes(frame(spark, [])).count() == 0 and drift.promote(drift.ingest(frame(spark, []))).count() == 0


def test_pairs_across_blocks(spark):
    import random

    r = random.Random(3)
    rows = [(i, i % 3, r.randint(-50, 3000)) for i in range(400)]
    df = spark.createDataFrame(rows, "file_id bigint, sheet_id bigint, version_no int")
    want = {}
    for s in range(3):
        first = {}
        for i, _, v in sorted(x for x in rows if x[1] == s):
            first.setdefault(v, i)
        vs = sorted(first)
        want |= {first[b]: first[a] for a, b in zip(vs, vs[1:], strict=False)}
    assert dict(map(tuple, drift.version_pairs(df, block=16).collect())) == want


def test_one_table_and_replay(spark):
    rows = [(1, 1, 1, "a.csv", "id,English,Native,Edited Y/N,Zeta,id\ninst-1,a,b,yes,z,dup\n\n,,,,,\ninst-2,c\ninst-3,d,e,maybe,,,extra\n")]
    got = {r.id: r for r in drift.promote(drift.ingest(frame(spark, rows))).collect()}
    assert set(got) == {"inst-1", "inst-2", "inst-3"}
    assert (got["inst-1"].translation, got["inst-1"].edited) == ("b", True)
    assert '"Zeta":"z"' in got["inst-1"]._rescued and '"id#2":"dup"' in got["inst-1"]._rescued
    assert got["inst-2"].translation is None and got["inst-2"]._rescued is None
    assert got["inst-3"].edited is None and "maybe" in got["inst-3"]._rescued and "extra" in got["inst-3"]._rescued


def test_two_aliases_lose_nothing(spark):
    import json

    heads = ("Edited Y/N,Edited,G-Translation,MT Translation", "Edited,Edited Y/N,MT Translation,G-Translation")
    cells = [{"Edited Y/N": "Y", "Edited": "N", "G-Translation": "g", "MT Translation": "m"}, {"Edited Y/N": "Y", "Edited": "Y/N"}, {"Edited": "", "Edited Y/N": "N"}, {"Edited": "Y", "Edited Y/N": "maybe", "MT Translation": "m"}]
    for i, head in enumerate(heads):
        text = f"id,{head}\n" + "".join(f"inst-{k}," + ",".join(c.get(h, "") for h in head.split(",")) + "\n" for k, c in enumerate(cells))
        got = {r.id: (r.edited, r.g_translation, json.loads(r._rescued or "{}")) for r in drift.promote(drift.ingest(frame(spark, [(i, 1, 1, "a.csv", text)]))).collect()}
        assert got == {
            "inst-0": (False, "g", {"Edited Y/N": "Y", "MT Translation": "m"}), "inst-1": (True, None, {"Edited": "Y/N"}),
            "inst-2": (False, None, {}), "inst-3": (True, "m", {"Edited Y/N": "maybe"}),
        }


@pytest.mark.parametrize(("cell", "kind"), [("Y", "flag"), ("no", "flag"), ("TRUE", "flag"), ("12", "whole"), ("-3", "whole"), ("2024-05-01", "date"), ("2024-05-01 10:11", "date"), ("1 May 2024", "date"), ("03/04/2024", "date"), ("May 1, 2024", "date"), ("3.5", "text"), ("yes please", "text")])
def test_kinds(cell, kind):
    assert drift.value_kind(cell) == kind


def plainly(files):
    """Changes of all sheets by comparing tables cell by cell."""
    import csv
    import io

    def read(r):
        rows = list(csv.reader(io.StringIO(r.file_text.lstrip("﻿"), newline=""), delimiter="\t" if r.file_name.endswith(".tsv") else ","))
        head = [h.strip("﻿ ") for h in rows[0]]
        key = next(i for i, h in enumerate(head) if h.lower() in ("id", "prompt_id"))
        cols = {h: {} for h in head}
        for row in rows[1:]:
            for h, c in zip(head, row, strict=True):
                cols[h].setdefault(row[key], c.replace("\r\n", "\n"))
        return cols, [r[key] for r in rows[1:]]

    out = set()
    sheets = {}
    for r in sorted(files, key=lambda r: r.file_id):
        sheets.setdefault(r.sheet_id, {}).setdefault(r.version_no, r)
    for versions in sheets.values():
        order = [versions[v] for v in sorted(versions)]
        for a, b in zip(order, order[1:], strict=False):
            (old, ids), (new, ids2) = read(a), read(b)
            both = [i for i in ids if i in ids2]
            gone = [h for h in old if h not in new]
            for h in new:
                if h in old:
                    kinds = [drift.column_kind(list(c.values())) for c in (old[h], new[h])]
                    if None not in kinds and kinds[0] != kinds[1]:
                        out.add((b.file_id, "retyped", h))
                    continue
                twin = next((g for g in gone if both and all(old[g][i] == new[h][i] for i in both)), None)
                if twin is None:
                    out.add((b.file_id, "added", h))
                else:
                    gone.remove(twin)
                    out.add((b.file_id, "renamed", h))
            out |= {(b.file_id, "removed", h) for h in gone}
    return out


def test_whole_table(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    files = spark.read.parquet(f"{folder}/prompt_files.parquet")
    rows = [tuple(r) for r in drift.changes(files).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plainly(files.collect()) and len(rows) > 30


def test_any_schema_and_cells_that_do_not_fit(spark):
    schema = drift.TargetSchema({"key": "string", "n": "int", "ok": "boolean", "day": "date", "x": "double"}, {"key": ("ID",)}).promote("big", "bigint", "Big Number")
    text = "ID,n,ok,day,x,Big Number,other\na,1,yes,2024-01-02,1.5,9000000000,z\nb,3000000000,maybe,2 May,one,1e3,\n"
    df = spark.createDataFrame([(1, 1, 1, "a.csv", text)], "file_id bigint, sheet_id bigint, version_no int, file_name string, file_text string")
    a, b = drift.ingest(df, schema).orderBy("row_no").collect()
    assert (a.key, a.n, a.ok, str(a.day), a.x, a.big, a._rescued) == ("a", 1, True, "2024-01-02", 1.5, 9000000000, '{"other": "z"}')
    assert (b.key, b.n, b.ok, b.day, b.x, b.big) == ("b", None, None, None, None, None)
    assert json.loads(b._rescued) == {"n": "3000000000", "ok": "maybe", "day": "2 May", "x": "one", "Big Number": "1e3"}
    later = df.unionByName(df.withColumn("file_id", F.lit(2).cast("bigint")).withColumn("version_no", F.lit(2)).withColumn("file_text", F.lit(text.replace("yes", "7").replace("maybe", "8").replace("ok", "OK?"))))
    assert {tuple(r) for r in drift.changes(later, schema).collect()} == {(2, "added", "OK?"), (2, "removed", "ok")}
    with pytest.raises(ValueError):
        drift.ingest(df, drift.TargetSchema({"a": "map<string,string>"}))
