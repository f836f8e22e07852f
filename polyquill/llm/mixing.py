"""Mixing sources to target weights (problem 7).

Records are aggregated by membership pattern (the set of sources a record lies
in) to token sums, which make a small flow network: patterns feed sources,
sources feed the mix. Repeating a record once more costs more each time, going
beyond a source's quota costs more than any repetition and the more the further
it goes, so a minimum-cost flow fills quotas first, repeats as little as it can,
and spreads what some sources cannot give over the others in proportion to
their quotas. Flows become records by seeded hashes: so many full passes, and
of the last pass the records whose hash lies below a threshold, found from
token histograms of ever finer hash ranges.

The network has one node per pattern and source; records, hashes and texts
never reach the driver.

Defined results: records without a source, or only of sources without a target,
and records without a token stay out; a source that has no records gets none;
shares are taken relative to their sum; several targets of one source add up,
with the greatest number of repeats; null shares and repeats count as 0 and 1;
if all sources together cannot fill the size, the mix is as large as they can
make it. The network holds the MAX_PATTERNS patterns with the most tokens as
they are; records of any others stand in it with one of their sources, chosen
by hash, so that no record is left out whatever the number of patterns.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquill.session import ensure_checkpoint_dir

SEED = 17
#: Over-filling is costed in steps of this share of a quota.
OVER_STEP = 0.01
#: Patterns the network holds as they are (all of those of up to nine sources).
MAX_PATTERNS = 512
_HASH_BITS = 12


class ConvexArc:
    """An arc whose unit cost rises in steps [(capacity, cost)]."""

    def __init__(self, steps: list[tuple[int, float]]) -> None:
        self.steps = [s for s in steps if s[0] > 0]
        self.flow = 0

    def ahead(self) -> tuple[int, float] | None:
        """Room and unit cost of the next step."""
        past = 0
        for capacity, cost in self.steps:
            past += capacity
            if self.flow < past:
                return past - self.flow, cost
        return None

    def back(self) -> tuple[int, float] | None:
        """What the step in use holds, and the cost it gives back."""
        past = 0
        for capacity, cost in self.steps:
            if past < self.flow <= past + capacity:
                return self.flow - past, cost
            past += capacity
        return None


def min_cost_flow(arcs: dict[tuple[str, str], ConvexArc], source: str, sink: str, amount: int) -> int:
    """Sends up to `amount` at least cost by successive shortest paths; returns
    what could be sent. Flows are left in the arcs."""
    nodes = {source, sink, *(x for arc in arcs for x in arc)}
    leaving: dict[str, list[tuple[str, ConvexArc, int]]] = {x: [] for x in nodes}
    for (a, b), arc in arcs.items():
        leaving[a].append((b, arc, 1))
        leaving[b].append((a, arc, -1))
    sent = 0
    while sent < amount:
        cost = dict.fromkeys(nodes, math.inf)
        cost[source] = 0.0
        came: dict[str, tuple[str, ConvexArc, int, int]] = {}
        todo, waiting = deque([source]), {source}
        while todo:
            a = todo.popleft()
            waiting.discard(a)
            for b, arc, sign in leaving[a]:
                step = arc.ahead() if sign > 0 else arc.back()
                if step and cost[a] + sign * step[1] < cost[b] - 1e-9:
                    cost[b], came[b] = cost[a] + sign * step[1], (a, arc, step[0], sign)
                    if b not in waiting:
                        waiting.add(b)
                        todo.append(b)
        if cost[sink] == math.inf:
            break
        path, at = [], sink
        while at != source:
            before, arc, room, sign = came[at]
            path.append((arc, room, sign))
            at = before
        push = min([amount - sent, *(room for _, room, _ in path)])
        for arc, _, sign in path:
            arc.flow += sign * push
        sent += push
    return sent


@dataclass(frozen=True)
class Share:
    """Of one pattern and source: full passes over its records, and tokens of a
    further pass."""

    passes: int
    rest: int


def _beyond(quota: int, size: int, over: float) -> list[tuple[int, float]]:
    """Steps beyond a quota up to the whole size: each costs in proportion to how
    far it goes beyond, so what is spread stays in proportion to the quotas.
    Steps are OVER_STEP of the quota wide, and ten times as wide from one, ten,
    a hundred times the quota on."""
    steps, done, width, upto = [], 0.0, OVER_STEP, 1.0
    while done * quota < size:
        steps.append((max(1, round(width * quota)), over * (1 + done / OVER_STEP)))
        done += max(width, 1 / quota)
        if done >= upto:
            width, upto = width * 10, upto * 10
    return steps


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], size: int) -> dict[tuple[tuple[str, ...], str], Share]:
    """Passes of every pattern for every source. patterns: tokens by sources;
    targets: share and repeats by source."""
    whole = sum(share for share, _ in targets.values())
    most = max([1, *(repeats for _, repeats in targets.values())])
    over = float(most * most + 1)
    arcs: dict[tuple[str, str], ConvexArc] = {}
    names = {f"p{i}": p for i, p in enumerate(sorted(patterns))}
    for name, p in names.items():
        tokens = patterns[p]
        arcs["in", name] = ConvexArc([(tokens * most * max(1, len(p)), 0.0)])
        for s in p:
            if s in targets:
                arcs[name, f"s:{s}"] = ConvexArc([(tokens, float(r * r)) for r in range(targets[s][1])])
    for s, (share, _) in targets.items():
        quota = round(size * share / whole) if whole else 0
        arcs[f"s:{s}", "out"] = ConvexArc([(quota, 0.0), *(_beyond(quota, size, over) if quota else [])])
    min_cost_flow(arcs, "in", "out", size)
    out = {}
    for name, p in names.items():
        for s in p:
            arc = arcs.get((name, f"s:{s}"))
            if arc and arc.flow and patterns[p]:
                out[p, s] = Share(*divmod(arc.flow, patterns[p]))
    return out


def _thresholds(rows: DataFrame, shares: dict[tuple[tuple[str, ...], str], Share]) -> dict[tuple[tuple[str, ...], str], int]:
    """For each share the hash below which records belong to its last pass: the
    longest run of records by hash that the rest has room for, to one record.
    Each round reads a histogram of 4096 ranges inside the range found before."""
    low = {k: 0 for k, s in shares.items() if s.rest}
    room = {k: shares[k].rest for k in low}
    for depth in range(1, 5):
        if not room:
            break
        shift = 60 - _HASH_BITS * depth
        within = [(list(p), s, low[p, s] >> (shift + _HASH_BITS)) for p, s in room]
        small = rows.sparkSession.createDataFrame(within, "pattern array<string>, source string, prefix bigint")
        inside = rows.withColumn("prefix", F.shiftright("h", shift + _HASH_BITS)).join(F.broadcast(small), ["pattern", "source", "prefix"])
        cells = inside.groupBy("pattern", "source", F.shiftright("h", shift).alias("cell")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("records")).collect()
        by: dict[tuple[tuple[str, ...], str], list] = {}
        for r in cells:
            by.setdefault((tuple(r.pattern), r.source), []).append((r.cell, r.n, r.records))
        for k in list(room):
            for cell, n, records in sorted(by.get(k, [])):
                if n <= room[k]:
                    room[k] -= n
                    low[k] = (cell + 1) << shift
                    continue
                low[k] = cell << shift
                if records == 1 or depth == 4:
                    del room[k]
                break
            else:
                del room[k]
    return low


def memberships(counted: DataFrame, sources_col: str, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per record and source of it that has a target: record columns,
    pattern, source, h (60 bits)."""
    wanted = targets.where("source is not null").agg(F.collect_set("source").alias("_wanted"))  # one row, one entry a target
    rows = counted.crossJoin(F.broadcast(wanted)).withColumn("pattern", F.array_sort(F.array_intersect(F.col(sources_col), F.col("_wanted")))).drop("_wanted")
    rows = rows.where((F.size("pattern") > 0) & (F.col("n_tokens") > 0)).withColumn("source", F.explode("pattern"))
    return rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.lit(seed)), 4))


def mix(counted: DataFrame, targets: DataFrame, sources_col: str = "sources", size: int | None = None, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mix. `counted` has doc_id,
    n_tokens and an array of sources; `size` is by default all its tokens,
    those of records that stay out included."""
    ensure_checkpoint_dir(counted.sparkSession)
    counted = counted.select("doc_id", "n_tokens", sources_col).checkpoint()  # tokenised once, read several times
    table = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    wanted = {r.source: (float(r.share), max(0, int(r.repeats))) for r in table.collect()}
    if size is None:
        size = int(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    rows = memberships(counted, sources_col, targets, seed)
    first = F.col("source") == F.get("pattern", F.lit(0))
    held = rows.where(first).groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
    if held.limit(max_patterns + 1).count() > max_patterns:
        most = F.broadcast(held.orderBy(F.desc("n"), "pattern").limit(max_patterns).select("pattern", F.lit(True).alias("_kept")))  # max_patterns rows
        own = F.get("pattern", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.size("pattern")).cast("int"))
        rows = rows.join(most, "pattern", "left").withColumn("_own", own).where(F.col("_kept") | (F.col("source") == F.col("_own")))
        rows = rows.withColumn("pattern", F.when(F.col("_kept"), F.col("pattern")).otherwise(F.array("source"))).drop("_kept", "_own").checkpoint()
        held = rows.where(first).groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
    sums = held.collect()  # at most max_patterns and the targets
    shares = plan({tuple(r.pattern): int(r.n) for r in sums}, wanted, size)
    below = _thresholds(rows, shares)
    small = counted.sparkSession.createDataFrame([(list(p), s, x.passes, below.get((p, s), 0)) for (p, s), x in shares.items()], "pattern array<string>, source string, passes int, below bigint")
    copies = (F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")
    chosen = rows.join(F.broadcast(small), ["pattern", "source"])  # a row for each pattern and source of it
    return chosen.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source got against its target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("mix_tokens").alias("_all"))
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(got, "source", "left").crossJoin(F.broadcast(whole))
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("mix_tokens", "records", "most_copies")}
    return rows.select("source", "target_share", "max_repeats", *(v.alias(k) for k, v in filled.items()), F.coalesce(F.try_divide("mix_tokens", "_all"), F.lit(0.0)).alias("actual_share"))
