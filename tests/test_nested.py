import json

from hypothesis import given, settings
from hypothesis import strategies as st
from polyquill.operators import nested

PAYLOADS = [
    (1, json.dumps({"q1": {"question": "x", "annotations": [{"answers": ["a", None, "b"], "en_answers": "e", "count": 2, "votes": [{"who": "w"}]}, None, {"answers": []}], "idks": {"idk": 1, "no-answer": None}}})),
    (2, '[{"ID": "q1", "aggregated_answers": {"answers": "one", "en_answers": null}}, {"no": "id"}, 7]'),
    (3, '{"q1": {"annotations": [{"answers": ["old"]}]}, "q1": {"annotations": [{"answers": ["new", "er"]}], "idks": null}}'),
    (4, '{"q1": {"annotations": [{"answers": ['), (5, None), (6, ""), (7, "  "), (8, "[1, 2]"), (9, '{"q1": NaN}'), (10, '{"q": {}}'),
]


def frame(spark, rows=PAYLOADS):
    return spark.createDataFrame(rows, "file_id bigint, payload string")


def test_flat_rows(spark):
    got = {tuple(r) for r in nested.annotation_nodes(frame(spark)).collect()}
    assert got == {
        (1, "q1", "group", 0, ""), (1, "q1", "answer", 0, "0"), (1, "q1", "answer", 0, "2"), (1, "q1", "en_answer", 0, "0"), (1, "q1", "vote", 0, "0"), (1, "q1", "group", 2, ""),
        (1, "q1", "idk", -1, "idk"), (1, "q1", "idk", -1, "no-answer"), (2, "q1", "group", 0, ""), (2, "q1", "answer", 0, "0"), (3, "q1", "group", 0, ""), (3, "q1", "answer", 0, "0"), (3, "q1", "answer", 0, "1"),
    }


def test_empty_and_clashing_columns(spark):
    assert nested.annotation_nodes(frame(spark, [])).count() == 0
    df = frame(spark).selectExpr("file_id", "payload", "'x' AS qid", "'y' AS node", "1 AS path")
    assert nested.annotation_nodes(df).count() == 13


def test_nodes_once_and_links(spark):
    df = frame(spark, [(1, PAYLOADS[0][1]), (2, PAYLOADS[0][1])])
    bridge, nodes = nested.bridge(df).collect(), nested.nodes(df).collect()
    assert len({n.node_hash for n in nodes}) == len(nodes) == len({b.node_hash for b in bridge})
    by = {(b.file_id, b.occ): b for b in bridge}
    assert all(b.parent_occ is None or by[b.file_id, b.parent_occ].node_hash == b.parent_hash for b in bridge)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["answers", "votes", "a", "b.c", ""]), x, max_size=3), max_leaves=12)


def canonical(v, field=False):
    if isinstance(v, dict):
        return {k: canonical(x) if x is None or k not in nested.LIST_FIELDS else [canonical(y) for y in (x if isinstance(x, list) else [x])] for k, x in v.items()}
    return [canonical(x) for x in v] if isinstance(v, list) else v


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from(["question", "annotations", "idks", "x"]), json_values, max_size=4))
def test_round_trip(record):
    shredder = nested.MerkleShredder()
    rows = shredder.shred(record)
    assert nested.rebuild(rows[0][7], shredder.store) == canonical(record)


def test_field_order_is_no_difference_list_order_is():
    h = lambda r: nested.MerkleShredder().shred(r)[0][7]
    assert h({"a": 1, "b": 2}) == h({"b": 2, "a": 1})
    assert h({"a": [1, 2]}) != h({"a": [2, 1]}) and h({"answers": []}) != h({}) and h({"a": "1"}) != h({"a": 1})


def test_deep_nesting():
    record = {"a": 1}
    for _ in range(5000):
        record = {"n": record}
    assert len(nested.MerkleShredder().shred(record)) == 5002


DEEP = '{"q1": {"annotations": [{"answers": ["a"]}], "x": ' + '{"n": [' * 10_000 + "7" + "]}" * 10_000 + '}, "q2": {"annotations": [{"answers": ["b", "c"], "count": ' + "9" * 5000 + "}]}}"


def test_no_depth_or_length_loses_a_record(spark):
    df = frame(spark, [(1, DEEP), (2, DEEP.replace("7", "")), (3, DEEP[:-2])])
    assert {tuple(r) for r in nested.annotation_nodes(df).collect()} == {(f, *x) for f in (1, 2) for x in (("q1", "group", 0, ""), ("q1", "answer", 0, "0"), ("q2", "group", 0, ""), ("q2", "answer", 0, "0"), ("q2", "answer", 0, "1"))}
    assert [(r.file_id, r.reason) for r in nested.unreadable(df).collect()] == [(3, "invalid JSON")]
    (qid, record), (_, long) = nested.read_records(DEEP)
    shredder = nested.MerkleShredder()
    rows = shredder.shred(record)
    assert len(rows) == 20_000 + 4 and max(len(r[2]) for r in rows) < 3000 and max(len(r[4]) for r in rows) <= nested.LEVELS + 1
    value, depth = nested.rebuild(rows[0][7], shredder.store)["x"], 0
    while isinstance(value, (dict, list)):
        value, depth = value["n"] if isinstance(value, dict) else value[0], depth + 1
    assert (value, depth) == (7, 20_000)
    group = long["annotations"][0]
    held = nested.MerkleShredder()
    top = held.shred(group)[0][7]
    assert nested.rebuild(top, held.store)["count"] == "9" * 5000
    store = nested.SubtreeStore()
    assert store.add(record) == store.add(nested.read_records(DEEP)[0][1]) != store.add(group)


def test_why_unreadable():
    assert [nested.why_unreadable(p) for p in (None, " ", "{}", "7", '{"q": {}}')] == [("empty", ""), ("empty", ""), ("no record", ""), ("no record", ""), None]
    assert nested.why_unreadable('{"q": NaN}')[0] == "invalid JSON"


@settings(max_examples=150, deadline=None)
@given(st.one_of(json_values.map(json.dumps), st.text(alphabet='{}[],:"a1 .-e\\t', max_size=12)))
def test_deep_parser_reads_as_the_platform_does(text):
    try:
        want = nested._DECODER.decode(text)
    except ValueError:
        want = ValueError
    try:
        got = nested.decode_deep(text)
    except ValueError:
        got = ValueError
    assert got == want


def test_groups_by_identity_and_bridge_agree(spark, data):
    from polyquill.session import table

    files = table(spark, data, "annotation_files")
    a, b = (sorted(map(tuple, x.collect())) for x in (nested.annotation_nodes(files), nested.flat_annotations(nested.bridge(files))))
    assert a == b and len(a) > 500


def plainly(payload):
    """The flat rows of one payload, read as the statement says."""
    try:
        doc = json.loads(payload) if payload else {}
    except ValueError:
        return set()
    records = doc if isinstance(doc, dict) else {r["ID"]: r for r in doc if isinstance(r, dict) and "ID" in r}
    many = lambda v: [] if v is None else v if isinstance(v, list) else [v]
    out = set()
    for qid, rec in records.items():
        if not isinstance(rec, dict):
            continue
        for field in ("annotations", "aggregated_answers"):
            for g, group in enumerate(many(rec.get(field))):
                if not isinstance(group, dict):
                    continue
                out.add((qid, "group", g, ""))
                for key, node in (("answers", "answer"), ("en_answers", "en_answer"), ("votes", "vote")):
                    out |= {(qid, node, g, str(i)) for i, v in enumerate(many(group.get(key))) if v is not None}
        if isinstance(rec.get("idks"), dict):
            out |= {(qid, "idk", -1, k) for k in rec["idks"]}
    return out


def test_whole_table(spark, data):
    from polyquill.session import table

    files = table(spark, data, "annotation_files")
    want = {(r.file_id, *x) for r in files.collect() for x in plainly(r.payload)}
    rows = [tuple(r) for r in nested.annotation_nodes(files).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 500
