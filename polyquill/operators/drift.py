"""Ingestion of delimited files whose columns drift (problem 5).

Rescue-column ingestion: each file is read against one target schema; a field
that the schema does not know, or a cell that does not fit its column's type,
is kept as JSON in the column `_rescued`; fields that are approved later are
promoted, and rescued values are replayed into their typed columns without
reading the files again. The change report compares the ingested rows of each
delivered version of a sheet with those of the one before it.

Defined results: a null or blank file, or one with a header only, has no rows;
a null or blank file is no delivered version and takes no part in the change
report. Short rows leave the last fields empty; cells beyond the header are
rescued under `_extra`; of two columns with one name the first stands and the
second is rescued as `name#2`; rows without any filled cell are none; empty
cells become nulls.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

csv.field_size_limit(2**31 - 1)

#: Words and letters of a yes/no flag, in lower case.
FLAG_WORDS = frozenset("y n yes no true false t f".split())
_WHOLE = re.compile(r"[+-]?\d+")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\.?"
_CLOCK = r"(?:[T ,]+\d{1,2}[:.]\d{2}(?:[:.]\d{2}(?:[.,]\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|[+-]\d{2}:?\d{2}))?)?"
_DATE = re.compile(
    rf"(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.](?:\d{{4}}|\d{{2}})"
    rf"|\d{{1,2}}[ -]{_MONTH},?[ -]\d{{4}}|{_MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}){_CLOCK}",
    re.IGNORECASE,
)


def value_kind(text: str) -> str:
    """flag, whole, date or text of one filled cell."""
    text = text.strip()
    if text.lower() in FLAG_WORDS:
        return "flag"
    if _WHOLE.fullmatch(text):
        return "whole"
    return "date" if _DATE.fullmatch(text) else "text"


def column_kind(cells: list[str]) -> str | None:
    """The one kind of all filled cells, else text; None without any."""
    kinds = {value_kind(c) for c in cells if c.strip()}
    return None if not kinds else kinds.pop() if len(kinds) == 1 else "text"


def clean_name(name: str) -> str:
    """A header name without byte-order mark and outer blanks."""
    return name.lstrip("\ufeff").strip()


#: A file without any such character is blank; Java's pattern needs the flag (?U) for Unicode blanks.
FILLED = r'[^\s,"\uFEFF]'
_FILLED = re.compile(FILLED)


def parse_file(file_name: str | None, text: str | None) -> tuple[list[str], list[list[str]]]:
    """Header and rows of one delimited file: tab for .tsv, else comma."""
    if not text or not _FILLED.search(text):
        return [], []
    # The mark is taken off first: before a quote it would hide the quoting.
    source = io.StringIO(text.lstrip("\ufeff"), newline="")
    rows = [r for r in csv.reader(source, delimiter="\t" if (file_name or "").lower().endswith(".tsv") else ",") if any(c.strip() for c in r)]
    if not rows:
        return [], []
    names: dict[str, None] = {}
    seen: dict[str, int] = {}
    for raw in rows[0]:
        name = unique = clean_name(raw)
        while unique in names:
            seen[name] = seen.get(name, 1) + 1
            unique = f"{name}#{seen[name]}"
        names[unique] = None
    # Line ends inside cells follow the file, not the content.
    return list(names), [[c.replace("\r\n", "\n").replace("\r", "\n") for c in r] for r in rows[1:]]


@dataclass(frozen=True)
class TargetSchema:
    """Typed columns with the header names they are read from. Names compare in
    lower case without anything but letters and digits."""

    columns: dict[str, str]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def lookup(self) -> dict[str, str]:
        return {squash(a): c for c in self.columns for a in (c, *self.aliases.get(c, ()))}

    def promote(self, name: str, kind: str, *aliases: str) -> TargetSchema:
        """This schema with one more approved field."""
        return TargetSchema(self.columns | {name: kind}, self.aliases | {name: aliases})

    def as_text(self) -> TargetSchema:
        """The same columns, all of them text: cells as they are delivered."""
        return TargetSchema(dict.fromkeys(self.columns, "string"), self.aliases)


def squash(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


#: Prompt sheets as first agreed: everything else is rescued.
PROMPT_SCHEMA = TargetSchema(
    {"id": "string", "english": "string", "translation": "string"},
    {"id": ("prompt_id",), "translation": ("Local Translation", "Native")},
)
#: Fields approved since, with their types.
PROMOTED = {"g_translation": ("string", ("G-Translation", "MT Translation", "Google-Translation")), "edited": ("boolean", ("Edited Y/N", "EditedYN", "Edited?", "Edit"))}

_KEYS = (("file_id", "bigint"), ("sheet_id", "bigint"), ("version_no", "int"), ("row_no", "int"))
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}
_WHOLE_LIMIT = {"bigint": 1 << 63, "int": 1 << 31}


def cast_cell(text: str, kind: str) -> object:
    """A filled cell as a value of its column's type; None if it does not fit."""
    bare = text.strip()
    if kind == "string":
        return text
    if kind == "boolean":
        low = bare.lower()
        return True if low in ("y", "yes", "true", "t") else False if low in ("n", "no", "false", "f") else None
    try:
        if kind in _WHOLE_LIMIT:
            number = int(bare) if _WHOLE.fullmatch(bare) and len(bare) < 21 else None
            return number if number is not None and -_WHOLE_LIMIT[kind] <= number < _WHOLE_LIMIT[kind] else None
        return date.fromisoformat(bare) if kind == "date" else float(bare)
    except ValueError:
        return None


def _files(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("file_id").cast("bigint").alias("file_id"), F.col("sheet_id").cast("bigint").alias("sheet_id"), F.col("version_no").cast("int").alias("version_no"),
        F.col("file_name").cast("string").alias("file_name"), F.col("file_text").cast("string").alias("file_text"),
    )


#: The record before a file's rows: its header in order, each name with the
#: typed column it is read into, null where its cells are rescued.
HEADER_ROW = -1
_HEADER = ("_header", "array<struct<name:string,target:string>>")
_HEADER_ARROW = pa.list_(pa.struct([("name", pa.string()), ("target", pa.string())]))


def ingest_files(df: DataFrame, schema: TargetSchema = PROMPT_SCHEMA, blanks: bool = False) -> DataFrame:
    """All rows of all files in the target schema, each file's after a record
    (row_no -1) with its header; map-only. Columns of a schema may be of the
    types string, int, bigint, double, boolean and date; a cell that does not fit
    its column's type is rescued under its header name. With `blanks`, cells of
    white space are kept as they are."""
    lookup = schema.lookup()
    at = {c: i for i, c in enumerate(schema.columns)}
    kinds = list(schema.columns.values())
    if unknown := set(kinds) - set(_ARROW):
        raise ValueError(f"no column can be of type {', '.join(sorted(unknown))}")
    names_of = [*(k for k, _ in _KEYS), *at, "_rescued", _HEADER[0]]
    arrow = pa.schema([*((k, _ARROW[t]) for k, t in _KEYS), *((c, _ARROW[t]) for c, t in schema.columns.items()), ("_rescued", pa.string()), (_HEADER[0], _HEADER_ARROW)])
    if len(set(names_of)) < len(names_of):
        raise ValueError("a column has the name of a key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow.names]

            def add(*record: object) -> None:
                for col, x in zip(out, record, strict=True):  # noqa: B023
                    col.append(x)

            for file_id, sheet_id, version_no, file_name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, rows = parse_file(file_name, text)
                if not names:
                    continue
                targets: list[str | None] = []
                for name in names:
                    target = lookup.get(squash(name))
                    targets.append(None if target in targets else target)
                extra = "_extra"
                while extra in names:
                    extra += "_"
                add(file_id, sheet_id, version_no, HEADER_ROW, *[None] * len(at), None, [{"name": n, "target": t} for n, t in zip(names, targets, strict=True)])
                for row_no, row in enumerate(rows):
                    typed: list[object] = [None] * len(at)
                    rescued: dict[str, object] = {}
                    for k, cell in enumerate(row[: len(names)]):
                        if not (cell if blanks else cell.strip()):
                            continue
                        place = None if targets[k] is None else at[targets[k]]
                        value = None if place is None else cast_cell(cell, kinds[place])
                        if value is None:
                            rescued[names[k]] = cell
                        else:
                            typed[place] = value  # type: ignore[index]
                    if len(row) > len(names):
                        rescued[extra] = row[len(names) :]
                    add(file_id, sheet_id, version_no, row_no, *typed, json.dumps(rescued, ensure_ascii=False) if rescued else None, None)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    fields = (*_KEYS, *schema.columns.items(), ("_rescued", "string"), _HEADER)
    return _files(df).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def ingest(df: DataFrame, schema: TargetSchema = PROMPT_SCHEMA) -> DataFrame:
    """All rows of all files in the target schema; map-only. Unknown fields lie
    in `_rescued`, a JSON object by header name."""
    return ingest_files(df, schema).where(F.col("row_no") != HEADER_ROW).drop("_header")


def _typed(value: Column, kind: str) -> Column:
    if kind == "boolean":
        word = F.lower(F.trim(value))
        return F.when(word.isin("y", "yes", "true", "t"), F.lit(True)).when(word.isin("n", "no", "false", "f"), F.lit(False))
    return value.try_cast(kind)


def _first_fit(bag: Column, names: list[str], kind: str) -> Column:
    """The entry that is promoted: of those that fit, the one whose name comes
    first in `names`; of names that differ in marks only, the lesser."""
    rank = F.array(*(F.lit(n) for n in names))

    def ranked(entry: Column) -> Column:
        name = F.regexp_replace(F.lower(entry["key"]), r"[^\p{L}\p{N}]", "")
        return F.struct(F.array_position(rank, name).alias("rank"), entry["key"].alias("key"), entry["value"].alias("value"))

    return F.array_min(F.filter(F.transform(bag, ranked), lambda e: (e["rank"] > 0) & _typed(e["value"], kind).isNotNull()))


def promote(rows: DataFrame, approved: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Replay rescued values into typed columns, in built-in expressions. A
    value that does not fit its type stays in `_rescued`; so does all that is
    not approved. With several aliases filled, the first that fits stands, in
    the order name, then aliases as given; the others stay in `_rescued`."""
    approved = PROMOTED if approved is None else approved
    bag = F.from_json("_rescued", "map<string,string>")
    entries = F.coalesce(F.map_entries(bag), F.array().cast("array<struct<key:string,value:string>>"))
    rows = rows.withColumn("_bag", entries)
    for name, (kind, aliases) in approved.items():
        rows = rows.withColumn("_hit", _first_fit(F.col("_bag"), list(dict.fromkeys(squash(a) for a in (name, *aliases))), kind))
        rows = rows.withColumn(name, _typed(F.col("_hit.value"), kind)).withColumn("_bag", F.filter("_bag", lambda e: ~e["key"].eqNullSafe(F.col("_hit.key"))))
    return rows.withColumn("_rescued", F.when(F.size("_bag") > 0, F.to_json(F.map_from_entries("_bag")))).drop("_bag", "_hit")


# --- change report ---------------------------------------------------------

_DIGEST_SCHEMA = "file_id bigint, sheet_id bigint, version_no int, cols array<struct<name:string,kind:string>>, ids array<bigint>, cells array<array<bigint>>"
_DIGEST_ARROW = pa.schema(
    [("file_id", pa.int64()), ("sheet_id", pa.int64()), ("version_no", pa.int32()), ("cols", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())]))), ("ids", pa.list_(pa.int64())), ("cells", pa.list_(pa.list_(pa.int64())))]
)
_PROMPT_ID = re.compile(r"[A-Za-z]+-\d+")
ID_NAMES = ("id", "promptid")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def id_column(names: list[str], rows: list[list[str]]) -> int | None:
    """The column of prompt ids: by name, else the first one all whose filled
    cells look like ids."""
    named = [i for i, n in enumerate(names) if squash(n) in ID_NAMES]
    cells = lambda i: [r[i].strip() for r in rows if i < len(r) and r[i].strip()]
    fitting = [i for i in range(len(names)) if (c := cells(i)) and all(_PROMPT_ID.fullmatch(x) for x in c)]
    return next((i for i in fitting if i in named), next(iter(fitting or named), None))


def file_digest(names: list[str], rows: list[list[str]]) -> tuple[list[dict], list[int], list[list[int]]]:
    """Columns with kinds, prompt ids, and cells by column."""
    key = id_column(names, rows)
    first: dict[str, list[str]] = {}  # of a repeated prompt id the first row stands
    for row in rows:
        first.setdefault(row[key].strip() if key is not None else "", row)
    cols = [{"name": n, "kind": column_kind([r[i] for r in rows])} for i, n in enumerate(names)]
    return cols, [_hash(k) for k in first], [[_hash(r[i]) for r in first.values()] for i in range(len(names))]


def digest(df: DataFrame, schema: TargetSchema = PROMPT_SCHEMA) -> DataFrame:
    """Per ingested file its columns with kinds, prompt ids and cells as 64-bit
    hashes. A cell is read from the typed column its header name goes to, else
    from `_rescued`. Made beside the scan, where a file's rows still follow its
    header in one partition, so that the comparison never shuffles texts."""
    columns = list(schema.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, targets, rows = None, [], [], []
        for batch in batches:
            out: list[list] = [[] for _ in _DIGEST_ARROW.names]
            for file_id, sheet_id, version_no, row_no, *typed, rescued, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_no == HEADER_ROW:
                    if key is not None:
                        for col, x in zip(out, (*key, *file_digest(names, rows)), strict=True):
                            col.append(x)
                    key, names, rows = (file_id, sheet_id, version_no), [h["name"] for h in header], []
                    targets = [None if h["target"] is None else columns.index(h["target"]) for h in header]
                else:
                    bag = json.loads(rescued) if rescued else {}
                    rows.append([(bag.get(n) if t is None else typed[t]) or "" for n, t in zip(names, targets, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DIGEST_ARROW.types, strict=True)], schema=_DIGEST_ARROW)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *file_digest(names, rows)), _DIGEST_ARROW.types, strict=True)], schema=_DIGEST_ARROW)

    return ingest_files(df, schema.as_text(), blanks=True).mapInArrow(run, _DIGEST_SCHEMA)


VERSION_BLOCK = 256


def version_pairs(files: DataFrame, block: int = VERSION_BLOCK) -> DataFrame:
    """file_id and the file of the next lower delivered version of its sheet.
    Windows run over blocks of version numbers, and only each block's last
    version is carried to the next block: no task ever holds a whole sheet."""
    one = files.where(F.col("version_no").isNotNull()).groupBy("sheet_id", "version_no").agg(F.min("file_id").alias("file_id"))
    one = one.withColumn("blk", F.floor(F.col("version_no") / F.lit(block)))
    in_block = one.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("sheet_id", "blk").orderBy("version_no")))
    last = one.groupBy("sheet_id", "blk").agg(F.max_by("file_id", "version_no").alias("last_id"))
    carried = last.withColumn("carry_id", F.lag("last_id").over(Window.partitionBy("sheet_id").orderBy("blk"))).select(F.col("sheet_id").alias("s"), F.col("blk").alias("b"), "carry_id")
    joined = in_block.join(carried, F.col("sheet_id").eqNullSafe(F.col("s")) & (F.col("blk") == F.col("b")), "left")
    return joined.select("file_id", F.coalesce("prev_id", "carry_id").alias("prev_id")).where(F.col("prev_id").isNotNull())


def compare_columns(prev: tuple[list, list, list], cur: tuple[list, list, list]) -> list[tuple[str, str]]:
    """(change_kind, field_name) between two digests (cols, ids, cells)."""
    (pc, pi, px), (cc, ci, cx) = prev, cur
    p_at, c_at = {i: k for k, i in enumerate(pi)}, {i: k for k, i in enumerate(ci)}
    both = [i for i in ci if i in p_at]
    old = {c["name"]: (c["kind"], [px[k][p_at[i]] for i in both]) for k, c in enumerate(pc)}
    new = {c["name"]: (c["kind"], [cx[k][c_at[i]] for i in both]) for k, c in enumerate(cc)}
    out = [("retyped", n) for n, (kind, _) in new.items() if n in old and kind and old[n][0] and kind != old[n][0]]
    gone = {n: v for n, v in old.items() if n not in new}
    for name, (_, cells) in new.items():
        if name in old:
            continue
        twin = next((n for n, v in gone.items() if v[1] == cells), None) if both else None
        if twin is None:
            out.append(("added", name))
        else:
            del gone[twin]
            out.append(("renamed", name))
    return out + [("removed", n) for n in gone]


CHANGE_SCHEMA = "file_id bigint, change_kind string, field_name string"
_CHANGE_ARROW = pa.schema([("file_id", pa.int64()), ("change_kind", pa.string()), ("field_name", pa.string())])


def changes(df: DataFrame, schema: TargetSchema = PROMPT_SCHEMA) -> DataFrame:
    """One row per change of a version against the one before it, from their
    ingested rows."""
    files = digest(df, schema)
    # Versions come from the table itself, so that files are parsed for their digests only.
    pairs = version_pairs(_files(df).where(F.col("file_text").rlike("(?U)" + FILLED)).select("sheet_id", "version_no", "file_id"))
    content = F.struct("cols", "ids", "cells")
    cur = files.select(F.col("file_id").alias("f"), content.alias("cur"))
    prev = files.select(F.col("file_id").alias("p"), content.alias("prev"))
    both = pairs.join(cur, F.col("file_id") == F.col("f")).join(prev, F.col("prev_id") == F.col("p")).select("file_id", "prev", "cur")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for file_id, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind, name in compare_columns((a["cols"], a["ids"], a["cells"]), (b["cols"], b["ids"], b["cells"])):
                    for col, x in zip(out, (file_id, kind, name), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CHANGE_ARROW.types, strict=True)], schema=_CHANGE_ARROW)

    return both.mapInArrow(run, CHANGE_SCHEMA)
