"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if the document holds at least `percent` of 100 of the item's distinct k-word shingles
(A-Z lowered, white-space words). Items are partitioned by the size of their set, to the next power of two. For each
partition the documents are cut into windows of that many shingles, so that a short item never meets a long document's
signature: whatever the document's length, windows are of the item's size. A window's COORDINATES minima are looked up
among the items' minima; one agreement makes (document, item) a candidate. An item whose contained shingles lie in two
windows agrees in none of 96 coordinates with a chance below 2e-7; scattered over more, the chance stays of that order.
Candidates are verified on the whole sets of shingles.

The items' index is broadcast; it is built for BLOCK_BYTES of item texts at a time, a pass over the documents each.

Null or empty document text: no shingles, no hits. Items with fewer than k words (or null) take no part, as they have no
shingle to compare. Null ids: kept as they are (drop_contaminated judges rows, not ids). Repeated rows: one result row for
each pair of rows that hit. Very long texts: only the candidates' shingles are kept of them. Extra columns are ignored.
Empty tables: no hits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_bytes, exact_shingles, map_batches, materialize, minima, shingle_stream, shingles_of, slices, stream

COORDINATES = 48
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


class Index:
    def __init__(self, items: list[tuple[int | None, bytes]], k: int):
        self.k = k
        self.ids = [i for i, _ in items]
        self.sets = [exact_shingles(t, k, short=False) for _, t in items]
        a, b = stream(31, COORDINATES) | np.uint64(1), stream(32, COORDINATES)
        self.partitions: dict[int, list[tuple[np.uint64, np.uint64, np.ndarray, list[list[int]]]]] = {}
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if s:
                by_size.setdefault(1 << (len(s)).bit_length(), []).append(i)
        for size, members in by_size.items():
            h, at = shingles_of([items[i][1] for i in members], k, short=False)
            tables = []
            for c in range(COORDINATES):
                values, place = np.unique(minima(h, at[:-1], a[c], b[c]), return_inverse=True)
                holders: list[list[int]] = [[] for _ in values]
                for i, p in zip(members, place, strict=True):
                    holders[p].append(i)
                tables.append((a[c], b[c], values, holders))
            self.partitions[size] = tables

    def hits(self, texts: list[bytes], percent: int) -> list[tuple[int, int, int, int]]:
        """(text number, item number, item's shingles, shared)."""
        out = []
        for lo, hi in chunks(texts):
            part = texts[lo:hi]
            h, at = shingles_of(part, self.k, short=False)
            if not len(h):
                continue
            found: set[tuple[int, int]] = set()
            counts = np.diff(at)
            for size, tables in self.partitions.items():
                windows = -(-counts // size)
                doc = np.repeat(np.arange(len(part)), windows)
                first = np.concatenate(([0], np.cumsum(windows)))
                begins = at[:-1][doc] + (np.arange(len(doc)) - first[doc]) * size
                for a, b, values, holders in tables:
                    least = minima(h, begins, a, b)
                    place = np.minimum(np.searchsorted(values, least), len(values) - 1)
                    for w in np.flatnonzero(values[place] == least):
                        found.update((int(doc[w]), i) for i in holders[place[w]])
            last, own = -1, set()
            for d, i in sorted(found):
                if d != last:  # only what a candidate holds is kept of a text, however long
                    wanted = set().union(*(self.sets[j] for e, j in found if e == d))
                    last, own = d, {s for s in shingle_stream(part[d], self.k) if s in wanted}
                shared = len(own & self.sets[i])
                if 100 * shared >= percent * len(self.sets[i]):
                    out.append((lo + d, i, len(self.sets[i]), shared))
        return out


def _indexes(benchmark: DataFrame, k: int):
    """Broadcast item texts, BLOCK_BYTES of them at a time."""
    spark = benchmark.sparkSession
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # BLOCK_BYTES, about
        yield spark.sparkContext.broadcast(sorted(((r.item_id, r.text.encode()) for r in mine), key=lambda x: (x[0] is None, x)))


def find(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for each item found in a row of docs: narrow passes, no shuffle."""
    return reduce(DataFrame.union, [_pass(docs, shared, k, percent) for shared in _indexes(benchmark, k)])


def _pass(docs: DataFrame, shared, k: int, percent: int) -> DataFrame:
    built: list[Index] = []

    def work(batch):
        if not built:
            built.append(Index(shared.value, k))
        index, ids = built[0], batch.column(0).to_pylist()
        found = index.hits(column_bytes(batch.column(1)), percent)
        return {"doc_id": [ids[d] for d, *_ in found], "item_id": [index.ids[i] for _, i, *_ in found], "item_shingles": [n for *_, n, _ in found], "shared": [s for *_, s in found], "containment": [s / n for *_, n, s in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all its columns, without the rows in which an item is found, whatever their ids: narrow passes."""
    at, schema = docs.columns.index("text"), docs.schema
    for shared in _indexes(benchmark, k):
        built: list[Index] = []

        def run(batches, shared=shared, built=built):
            for batch in slices(batches):
                if not built:
                    built.append(Index(shared.value, k))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, *_ in built[0].hits(column_bytes(batch.column(at)), percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
