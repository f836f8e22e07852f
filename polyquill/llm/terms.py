"""Frequency of every distinct value and n-gram (problem 1).

Records are read in blocks (Arrow batches). Over each block a generalised
suffix array on words is built by prefix doubling: the sorted order comes from
ranks of prefixes of length 1, 2, 4, ..., and the same ranks give the common
prefix of neighbours by descending powers of two. Suffixes that share a whole
value or an n-gram are an interval of the array: its width is the number of
occurrences, and the width less the adjacencies that stay within one record is
the number of records. A record lies in one block only, so both numbers add up
over blocks without error; the blocks' sums are what travels, so a value that
fills a third of all rows is one row a block.

Defined results: null records, null or blank values and null lists give no
terms, but the record counts; values longer than any n are counted whole as
well; of equal rows of one record (delivered twice) one stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term is rare in fewer records than this ...
RARE_RECORDS = 3
#: ... and common in more than this share of all records.
COMMON_SHARE = 0.02
#: Arrow rows a block is built of at most; larger blocks send fewer sums.
BLOCK_RECORDS = 20_000


def normalise(value: str) -> list[str]:
    """Words of a value in lower case."""
    return value.lower().split()


class SuffixArray:
    """Suffixes of many word sequences in sorted order.

    `symbols` holds all sequences one after another and `ends` where each
    position's own sequence ends; a suffix reaches to that end."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        self.n = n = len(symbols)
        self.ends = ends
        at = np.arange(n)
        self.length = ends - at
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
        #: ranks[j][i]: rank of the prefix of 2**j words of suffix i, cut at its end.
        self.ranks = [rank]
        step = 1
        while n and step < int(self.length.max()):
            after = np.where(at + step < ends, rank[np.minimum(at + step, n - 1)], 0)
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            self.ranks.append(rank)
            step *= 2
        #: Ties (equal suffixes) stay in order of position, so of record.
        self.order = np.argsort(rank, kind="stable")
        self.lcp = self._common_prefixes()

    def _common_prefixes(self) -> np.ndarray:
        """lcp[k]: words that suffixes order[k-1] and order[k] share; lcp[0] = 0."""
        lcp = np.zeros(self.n, np.int64)
        if self.n < 2:
            return lcp
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.length[a], self.length[b])
        shared = np.zeros(self.n - 1, np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            fits = shared + (1 << j) <= most
            x, y = np.minimum(a + shared, self.n - 1), np.minimum(b + shared, self.n - 1)
            shared += np.where(fits & (self.ranks[j][x] == self.ranks[j][y]), 1 << j, 0)
        lcp[1:] = shared
        return lcp

    def intervals(self, width: np.ndarray, keep: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes `keep`, each read as its first `width` words: one
        position of every distinct string, its occurrences and its records.
        `keep` and `width` are by position."""
        order = self.order[keep[self.order]]
        if not len(order):
            return order, order, order
        place = np.flatnonzero(keep[self.order])
        # The least common prefix between kept neighbours, over those skipped.
        low = np.minimum.reduceat(self.lcp[: place[-1] + 1], place[:-1] + 1) if len(place) > 1 else np.empty(0, np.int64)
        same = (low >= width[order[1:]]) & (width[order[:-1]] == width[order[1:]]) if len(place) > 1 else np.empty(0, bool)
        interval = np.concatenate([[0], np.cumsum(~same)])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.bincount(interval)
        # Within an interval records come in order; neighbours of one record
        # are its duplicates there.
        by = np.lexsort((record[order], interval))
        i, r = interval[by], record[order][by]
        duplicate = np.concatenate([[False], (i[1:] == i[:-1]) & (r[1:] == r[:-1])])
        return order[first], count, count - np.bincount(i, weights=duplicate, minlength=len(count)).astype(np.int64)


def block_counts(records: list[list[str | None] | None], max_n: int | None = 0) -> Iterator[tuple[str, int, int, int]]:
    """(term, n, occurrences, records) of one block: whole values with n = 0 and
    n-grams within values with n = 1 .. max_n, None for the longest value's."""
    ids: dict[str, int] = {}
    symbols, ends, record, heads = [], [], [], []
    for r, values in enumerate(records):
        for value in values or ():
            words = normalise(value) if value else ()
            if not words:
                continue
            start = len(symbols)
            symbols += [ids.setdefault(w, len(ids)) for w in words]
            ends += [len(symbols)] * len(words)
            record += [r] * len(words)
            heads.append(start)
    if not symbols:
        return
    sa = SuffixArray(np.array(symbols), np.array(ends))
    of, text = np.array(record), list(ids)
    keep = np.zeros(sa.n, bool)
    keep[heads] = True
    for n in range((int(sa.length.max()) if max_n is None else max_n) + 1):
        width = sa.length if n == 0 else np.full(sa.n, n)
        for i, occurrences, held in zip(*sa.intervals(width, keep if n == 0 else sa.length >= n, of), strict=True):
            yield " ".join(text[s] for s in symbols[i : i + (n or int(sa.length[i]))]), n, int(occurrences), int(held)


_COUNT_ARROW = pa.schema([("term", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def counts(df: DataFrame, values_col: str, max_n: int | None = 0) -> DataFrame:
    """(term, n, occurrences, records) over all rows of `df`, one row a record
    with an array of strings: whole values (n = 0) and n-grams up to
    max_n, with None all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[list]:
            held: list = []
            for batch in batches:
                held += batch.column(0).to_pylist()
                if len(held) >= BLOCK_RECORDS:
                    yield held
                    held = []
            yield held

        for block in blocks():
            for part in batched(block_counts(block, max_n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _COUNT_ARROW.types, strict=True)], schema=_COUNT_ARROW)

    each = df.select(F.col(values_col).cast("array<string>").alias("_values")).mapInArrow(run, "term string, n int, occurrences bigint, records bigint")
    return each.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def annotation_records(annotations: DataFrame) -> DataFrame:
    """(country, qid, values): of each (country, qid) the English answers of the
    row with the greatest loaded_at, of equal ones that with the greatest id."""
    values = F.flatten(F.transform(F.filter("annotations", lambda g: g.isNotNull()), lambda g: F.coalesce(g["en_answers"], F.array().cast("array<string>"))))
    latest = F.max_by(F.struct(values.alias("v")), F.struct("loaded_at", "ann_id"))
    return annotations.groupBy("country", "qid").agg(latest.alias("_last")).select("country", "qid", F.col("_last.v").alias("values"))


def mark_terms(terms: DataFrame, total: DataFrame, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """Adds `mark`: rare, common or null. `total` is one row with n_records."""
    mark = F.when(F.col("records") < rare_records, "rare").when(F.col("records") > common_share * F.col("n_records"), "common")
    return terms.crossJoin(F.broadcast(total)).withColumn("mark", mark)
