"""Nested JSON records as related flat tables (problem 4).

Every JSON value below a record becomes one *occurrence*: a bridge row that
names its file, record, parent occurrence, field path and ordinals. Values are
canonicalised and hashed bottom-up (a Merkle tree over the JSON value), so two
equal subtrees have one identity wherever they lie; the store keeps each
distinct value once; `rebuild` gets a record back from it.

    bridge(file_id, qid, occ, parent_occ, path, parent_path, ords, leaf_key,
           kind, node_hash, parent_hash)
    nodes(node_hash, kind, content, children)

`path` is the field path with `[]` for each list, e.g.
`annotations[].answers[]`; `ords` holds the position at each list of the path,
so `ords[0]` of a group's child is the group's position and no join is needed
to find it.

Depth and length of numbers have no limit: what the platform's parser cannot
hold is read without recursion, and integers too long for it stay text of kind
number. Paths and ordinals of values below LEVELS levels are cut to a digest of
the parent's path and the last ordinal (the whole chain follows from
parent_occ), so that a record takes space in proportion to its size.

Defined results: null, empty, blank or invalid payloads give no rows and are
named with their reason by `unreadable`; null values keep their position but are no rows; one value where a list is usual is
a list of one (only fields in `list_fields`); of a repeated key the last holds.
Records may come as an object by id or as a list of objects with an id field;
list elements without an id, or that are no objects, give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that are lists by convention; a bare value there is a list of one.
LIST_FIELDS = ("annotations", "aggregated_answers", "answers", "en_answers", "votes", "picked", "reviewers", "marks")
#: Fields that may name the record when records come as a list.
ID_FIELDS = ("ID", "id", "qid", "question_id")

BRIDGE_SCHEMA = (
    "file_id bigint, qid string, occ bigint, parent_occ bigint, path string, parent_path string, ords array<int>, "
    "leaf_key string, kind string, node_hash string, parent_hash string"
)
NODE_SCHEMA = "node_hash string, kind string, content string, children int"

_BRIDGE_ARROW = pa.schema(
    [("file_id", pa.int64()), ("qid", pa.string()), ("occ", pa.int64()), ("parent_occ", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()),
     ("ords", pa.list_(pa.int32())), ("leaf_key", pa.string()), ("kind", pa.string()), ("node_hash", pa.string()), ("parent_hash", pa.string())]
)
_NODE_ARROW = pa.schema([("node_hash", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("children", pa.int32())])


#: Levels down to which paths and ordinals are written out.
LEVELS = 200


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not valid JSON")


class LongNumber(str):
    """An integer of more digits than the platform converts, as it is written."""

    __slots__ = ()


def _integer(text: str) -> int | LongNumber:
    return int(text) if len(text) <= 4000 else LongNumber(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer)
_PART = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9a-zA-Z.+-])|true\b|false\b|null\b))')


def decode_deep(text: str) -> object:
    """A JSON value of any depth: one pass with a stack of open containers."""
    root: list = []
    stack: list[tuple[object, str | None]] = []  # container, key its next value goes to
    here: object = root
    key: str | None = None
    expect = "value"  # value, first (value or close), key, first-key, colon, next (comma or close)
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"no JSON at character {at}")
        at = m.end()
        mark, string, scalar = m.groups()
        if expect == "next":
            if mark == "," and here is not root:
                expect = "key" if isinstance(here, dict) else "value"
                continue
            if mark and mark in "]}" and here is not root and (mark == "}") == isinstance(here, dict):
                here, key = stack.pop()
                continue
        elif expect in ("key", "first-key"):
            if string:
                key, expect = _DECODER.decode(string), "colon"
                continue
            if mark == "}" and expect == "first-key":
                (here, key), expect = stack.pop(), "next"
                continue
        elif expect == "colon":
            if mark == ":":
                expect = "value"
                continue
        elif mark is None or mark in "{[" or (mark == "]" and expect == "first"):
            if mark == "]":
                (here, key), expect = stack.pop(), "next"
                continue
            value = {} if mark == "{" else [] if mark == "[" else _DECODER.decode(string or scalar)
            if isinstance(here, dict):
                here[key] = value
            else:
                here.append(value)  # type: ignore[attr-defined]
            expect = "next"
            if mark:
                stack.append((here, key))
                here, expect = value, "first-key" if mark == "{" else "first"
            continue
        raise ValueError(f"unexpected {m.group().strip()!r} before character {at}")
    if expect != "next" or here is not root:
        raise ValueError("ends before the value does")
    return root[0]


def decode(payload: str) -> object:
    text = payload.removeprefix("\ufeff")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return decode_deep(text)


def records_of(doc: object, id_fields: tuple[str, ...] = ID_FIELDS) -> list[tuple[str, dict]]:
    records: dict[str, dict] = {}
    if isinstance(doc, dict):
        records.update(doc)
    elif isinstance(doc, list):
        for item in doc:
            key = next((item[k] for k in id_fields if item.get(k) is not None), None) if isinstance(item, dict) else None
            if key is not None:
                records[str(key)] = item
    return [(qid, rec) for qid, rec in records.items() if isinstance(rec, dict)]


def read_records(payload: str | None, id_fields: tuple[str, ...] = ID_FIELDS) -> list[tuple[str, dict]]:
    """The records of one payload by id; [] if it is null or no valid JSON."""
    if not payload:
        return []
    try:
        return records_of(decode(payload), id_fields)
    except ValueError:
        return []


def why_unreadable(payload: str | None) -> tuple[str, str] | None:
    """Why a payload gives no rows, and where; None if it has records."""
    if payload is None or not payload.strip():
        return "empty", ""
    try:
        doc = decode(payload)
    except ValueError as error:
        return "invalid JSON", str(error)
    return None if records_of(doc) else ("no record", "")


_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _digest(kind: str, text: str) -> str:
    return hashlib.blake2b(f"{kind}:{text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


@lru_cache(maxsize=50_000)
def _scalar(kind: type, value: object) -> tuple[str, str, str]:
    """Kind, content and identity of a scalar; the common ones are kept."""
    name = "null" if value is None else "bool" if kind is bool else "string" if kind is str else "number"
    content = str(value) if kind is LongNumber else json.dumps(value, ensure_ascii=False)
    return name, content, _digest(name, content)


class MerkleShredder:
    """Shreds one record after another; keeps no state between records but the
    store of distinct nodes, which the caller drains per batch."""

    def __init__(self, list_fields: tuple[str, ...] = LIST_FIELDS) -> None:
        self.list_fields = frozenset(list_fields)
        self.store: dict[str, tuple[str, str, int]] = {}

    def shred(self, record: dict, occ: int = 0) -> list[tuple]:
        """Bridge rows of one record in document order: (occ, parent_occ, path,
        parent_path, ords, key, kind, hash, parent_hash)."""
        # Pre-order walk with an explicit stack (depth is then no recursion),
        # then hashes in reverse order: children always follow their parents.
        rows: list[list] = []
        parts: list[list[tuple]] = []
        values: list = []
        up: list[tuple] = []
        stack: list[tuple] = [(record, -1, "", (), "", -1)]
        while stack:
            value, parent, path, ords, key, at = stack.pop()
            i = len(rows)
            above = parent >= 0
            rows.append([occ + i, occ + parent if above else None, path, rows[parent][2] if above else None, ords, key, "", "", None])
            parts.append([])
            values.append(value)
            up.append((parent, key, at))
            if len(ords) > LEVELS:
                ords = ords[-1:]
            if path.count(".") + path.count("[") > LEVELS:
                path = "#" + _digest("path", path)
            if isinstance(value, dict):
                for k in reversed(list(value)):
                    child, name = value[k], f"{path}.{k}" if path else k
                    if k in self.list_fields and child is not None:
                        many = child if isinstance(child, list) else [child]
                        parts[i].append((k, -2, str(len(many))))
                        stack.extend((many[p], i, name + "[]", (*ords, p), k, p) for p in range(len(many) - 1, -1, -1) if many[p] is not None)
                    else:
                        stack.append((child, i, name, ords, k, -1))
            elif isinstance(value, list):
                parts[i].append(("", -2, str(len(value))))
                stack.extend((value[p], i, path + "[]", (*ords, p), key, p) for p in range(len(value) - 1, -1, -1) if value[p] is not None)
        for i in range(len(rows) - 1, -1, -1):
            value = values[i]
            if isinstance(value, (dict, list)):
                # Field order is no part of an object's identity, list order is.
                kind, content = "object" if isinstance(value, dict) else "list", _encode(sorted(parts[i]))
                h = _digest(kind, content)
            elif value.__class__ is str and len(value) > 200:
                kind, content, h = _scalar.__wrapped__(str, value)  # long texts are not worth keeping
            else:
                kind, content, h = _scalar(value.__class__, value)
            rows[i][6], rows[i][7] = kind, h
            parent, key, at = up[i]
            if parent >= 0:
                parts[parent].append(("" if isinstance(values[parent], list) else key, at, h))
            if h not in self.store:
                self.store[h] = (kind, content, sum(p[1] != -2 for p in parts[i]))
        for i, (parent, _, _) in enumerate(up):
            if parent >= 0:
                rows[i][8] = rows[parent][7]
        return [tuple(r) for r in rows]


def _rows_by_file(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def bridge(df: DataFrame, id_col: str = "file_id", payload_col: str = "payload", list_fields: tuple[str, ...] = LIST_FIELDS, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per occurrence of a JSON value in a record, with all columns or
    those named: the optimizer cannot see into Python, so a caller that needs
    few says so. Map-only: files are independent, so no shuffle and no skew
    beyond a single payload."""
    names = [n for n in _BRIDGE_ARROW.names if not columns or n in columns]
    at = [_BRIDGE_ARROW.names.index(n) for n in names]
    arrow = pa.schema([_BRIDGE_ARROW.field(i) for i in at])
    schema = ", ".join(f for f in BRIDGE_SCHEMA.split(", ") if f.split()[0] in names)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(_BRIDGE_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(cols[i], t) for i, t in zip(at, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, payload in _rows_by_file(batch):
                occ = 0
                for qid, record in read_records(payload):
                    rows = MerkleShredder(list_fields).shred(record, occ)
                    occ += len(rows)
                    out += [(file_id, qid, *row) for row in rows]
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    return df.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(payload_col).alias("payload")).mapInArrow(run, schema)


def nodes(df: DataFrame, id_col: str = "file_id", payload_col: str = "payload", list_fields: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """Each distinct object once. Batches drop their own repeats before the
    shuffle, so a subtree that fills a third of the input travels once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shredder = MerkleShredder(list_fields)
            for _, payload in _rows_by_file(batch):
                for _, record in read_records(payload):
                    shredder.shred(record)
            cols = list(zip(*((h, *v) for h, v in shredder.store.items()), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _NODE_ARROW.types, strict=True)], schema=_NODE_ARROW)

    each = df.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(payload_col).alias("payload")).mapInArrow(run, NODE_SCHEMA)
    return each.groupBy("node_hash").agg(F.min("kind").alias("kind"), F.min("content").alias("content"), F.min("children").alias("children"))


#: Kind of each flat row by its field path.
_NODE_OF_PATH = {
    f"{g}[]{tail}": node
    for g in ("annotations", "aggregated_answers")
    for tail, node in (("", "group"), (".answers[]", "answer"), (".en_answers[]", "en_answer"), (".votes[]", "vote"))
}


class SubtreeStore:
    """Each distinct JSON value once: values are interned bottom-up, a container
    by the identities of its parts (field order is no part of an object's
    identity, list order is). What is asked of a node is read once from the
    store; every occurrence only refers to it."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self._members: dict[int, tuple[list[str], list[str]]] = {}

    def _put(self, key: tuple) -> int:
        at = self.ids.setdefault(key, len(self.content))
        if at == len(self.content):
            self.content.append(key)
        return at

    def add(self, value: object, depth: int = 0) -> int:
        """The identity of a value."""
        kind = value.__class__
        if kind is dict:
            if depth > LEVELS:
                return self._add_deep(value)
            return self._put(("object", *sorted([(k, self.add(v, depth + 1)) for k, v in value.items()])))
        if kind is list:
            if depth > LEVELS:
                return self._add_deep(value)
            return self._put(("list", *[self.add(v, depth + 1) for v in value]))
        return self._put((kind, value))

    def _add_deep(self, value: object) -> int:
        """As add, for any depth: parts first, in the reverse of a walk from the top."""
        order, done = [value], {}
        for v in order:
            order += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        for v in reversed(order):
            if isinstance(v, dict):
                done[id(v)] = self._put(("object", *sorted((k, done[id(x)]) for k, x in v.items())))
            elif isinstance(v, list):
                done[id(v)] = self._put(("list", *(done[id(x)] for x in v)))
            else:
                done[id(v)] = self._put((v.__class__, v))
        return done[id(value)]

    def group(self, node: int) -> tuple[list[str], list[str]]:
        """Kinds and items of the flat rows of a group node, '' for itself; none
        if it is no object."""
        held = self._members.get(node)
        if held is None:
            key = self.content[node]
            kinds, items = [], []
            if key[0] == "object":
                kinds, items = ["group"], [""]
                for field, child in key[1:]:
                    kind = _MEMBER.get(field)
                    if kind:
                        part = self.content[child]
                        parts = part[1:] if part[0] == "list" else (child,)
                        own = [str(p) for p, x in enumerate(parts) if self.content[x] != _NULL]
                        kinds += [kind] * len(own)
                        items += own
            held = self._members[node] = kinds, items
        return held


_NULL = (None.__class__, None)
_MEMBER = {"answers": "answer", "en_answers": "en_answer", "votes": "vote"}
_FLAT_ARROW = pa.schema([("file_id", pa.int64()), ("qid", pa.string()), ("node", pa.string()), ("grp", pa.int32()), ("item", pa.string())])


def annotation_nodes(df: DataFrame, id_col: str = "file_id", payload_col: str = "payload") -> DataFrame:
    """Groups, answers, English answers, votes and idk counts as flat rows:
    file_id, qid, node, grp, item. Groups are stored once a batch by identity;
    an occurrence is a link (file, record, ordinal) to the stored group, whose
    rows it repeats. A group that is no object gives no row; a record with both
    group fields gives the rows of both. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 256):
                store = SubtreeStore()
                files: list = []
                qids: list[str] = []
                nodes_: list[str] = []
                grps: list[int] = []
                items: list[str] = []
                for file_id, payload in _rows_by_file(big.slice(start, 256)):
                    for qid, record in read_records(payload):
                        before = len(nodes_)
                        for name in ("annotations", "aggregated_answers"):
                            groups = record.get(name)
                            if groups is None:
                                continue
                            for g, group in enumerate(groups if isinstance(groups, list) else [groups]):
                                kinds, own = store.group(store.add(group)) if group is not None else ([], [])
                                nodes_ += kinds
                                items += own
                                grps += [g] * len(kinds)
                        idks = record.get("idks")
                        if isinstance(idks, dict):
                            nodes_ += ["idk"] * len(idks)
                            items += idks
                            grps += [-1] * len(idks)
                        n = len(nodes_) - before
                        files += [file_id] * n
                        qids += [qid] * n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((files, qids, nodes_, grps, items), _FLAT_ARROW.types, strict=True)], schema=_FLAT_ARROW)

    return df.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(payload_col).alias("payload")).mapInArrow(run, "file_id bigint, qid string, node string, grp int, item string")


def unreadable(df: DataFrame, id_col: str = "file_id", payload_col: str = "payload") -> DataFrame:
    """(file_id, reason, detail) of every payload that gives no record; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *why) for f, payload in _rows_by_file(batch) if (why := why_unreadable(payload))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["file_id", "reason", "detail"])

    return df.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(payload_col).alias("payload")).mapInArrow(run, "file_id bigint, reason string, detail string")


def flat_annotations(rows: DataFrame) -> DataFrame:
    """The flat rows of a bridge table; a projection, no join or shuffle. A
    group that is no object gives no row; a record with both group fields gives
    the rows of both."""
    is_idk = F.col("parent_path") == "idks"
    node = F.when(is_idk, F.lit("idk"))
    for path, name in _NODE_OF_PATH.items():
        node = node.when(F.col("path") == path, F.lit(name))
    found = rows.withColumn("node", node).where(F.col("node").isNotNull() & ((F.col("node") != "group") | (F.col("kind") == "object")))
    return found.select(
        "file_id", "qid", "node",
        F.when(is_idk, F.lit(-1)).otherwise(F.get("ords", F.lit(0))).cast("int").alias("grp"),
        F.when(is_idk, F.col("leaf_key")).when(F.col("node") == "group", F.lit("")).otherwise(F.get("ords", F.lit(1)).cast("string")).alias("item"),
    )


def rebuild(node_hash: str, store: dict[str, tuple[str, str]]) -> object:
    """The JSON value of a node from (kind, content) by hash, of any depth:
    lists in full, with null elements, and bare values of list fields as lists
    of one."""
    root: list = [None]
    open_: list[tuple[object, object, str]] = [(root, 0, node_hash)]
    while open_:
        holder, place, what = open_.pop()
        kind, content = store[what][:2]
        if kind not in ("object", "list"):
            value: object = LongNumber(content) if kind == "number" and len(content) > 4000 and content.lstrip("-").isdigit() else json.loads(content)
        else:
            parts = json.loads(content)
            size = next((int(n) for key, at, n in parts if at == -2 and key == ""), 0)
            value = {key: [None] * int(n) for key, at, n in parts if at == -2} if kind == "object" else [None] * size
            for key, at, child in parts:
                if at != -2:
                    open_.append((value[key] if kind == "object" and at >= 0 else value, at if at >= 0 else key, child))  # type: ignore[index]
        holder[place] = value  # type: ignore[index]
    return root[0]
