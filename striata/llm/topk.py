"""Exact top-k by inner product with pivot-table elimination.

Vectors are turned into integers, floor(256 * x). Distances of every vector to PIVOTS vectors of its length are tabled once.
For a query q and a candidate c, |d(q, p) - d(c, p)| is a lower bound of their distance for each pivot p, so the largest
one gives an upper bound of the inner product, (|q|^2 + |c|^2 - bound^2) / 2.

The candidates are laid out once by nearest pivot and distance to it, and read in tiles of neighbours. A tile's ranges of
pivot distances bound all its candidates at once. A query visits a block's tiles in the order of their bounds, and of a tile only
candidates whose own bound reaches the k-th score found so far, until no bound does: then no other can enter. The score
to reach starts at the k-th best of a sample that travels with the queries and rises over all that a task reads.

Queries are broadcast QUERY_BYTES at a time, a pass over the candidates each; so candidates are shuffled once, whatever the
number of queries, and a task sends on k rows a query at most. A second step ranks them.

Vectors that are null, empty, or hold nulls or non-finite components take no part; vectors of another length aren't
compared. Integer products must fit a long (they are exact whenever they do). Equal scores: smaller vec_id first. A row
whose vec_id is null takes no part. Rows with the query's own vec_id are no candidates; other repeated rows count one by
one. Fewer candidates than k: all are returned. Lengths beyond the PIVOT_BYTES commonest have no pivots: their candidates
are all evaluated. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

PIVOTS = 24
#: Candidates of each length whose best scores a query must reach from the start.
SAMPLE = 256
#: Bytes of pivots and sampled vectors of all lengths, and of queries in one pass, that are broadcast at most.
PIVOT_BYTES = 16 << 20
QUERY_BYTES = 16 << 20
#: Candidates of a tile, and tiles and queries that are looked at together.
TILE, TILES, QUERIES = 256, 16, 1024
LEAST = -(2**63)


def integers(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v (array<long>), n (length) of the rows of (vec_id, embedding) that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & finite)
    return used.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"), F.size("embedding").alias("n"))


def matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().astype(kind, copy=False).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; exact: they fit a double."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row of v to each pivot, by differences: small distances of large vectors keep their digits."""
    x = v.astype(np.float64)
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots.astype(np.float64)], axis=1)


class Search:
    """The k best of all candidates seen so far for queries of one length."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        self.ids, self.v, self.pivots, self.k = ids, v, pivots, k
        self.norm = (v.astype(np.float64) ** 2).sum(1)
        self.far = distances(v, pivots)
        self.best, self.who = np.full((len(ids), k), LEAST), np.full((len(ids), k), 2**63 - 1)
        self.least = np.full(len(ids), LEAST)  # what a score must reach
        if len(sample_ids) >= k:
            s = np.where(sample_ids[None, :] != ids[:, None], products(v, sample, self._exact(sample)), LEAST)
            self.least = np.sort(s, axis=1)[:, -k]

    def _exact(self, c: np.ndarray) -> bool:
        return max(self.norm.max(initial=0), (c.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**52

    def see(self, ids: np.ndarray, v: np.ndarray, far: np.ndarray) -> None:
        """A block of candidates, in tiles of neighbours."""
        norm, exact = (v.astype(np.float64) ** 2).sum(1), self._exact(v)
        starts = np.arange(0, len(ids), TILE)
        lo, hi, most = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts), np.maximum.reduceat(norm, starts)
        for a in range(0, len(self.ids), QUERIES):
            q = slice(a, a + QUERIES)
            gap = np.zeros((len(self.ids[q]), len(starts)))
            for p in range(far.shape[1]):
                mine = self.far[q, p][:, None]
                np.maximum(gap, np.maximum(lo[:, p][None, :] - mine, mine - hi[:, p][None, :]), out=gap)
            upper = _upper(self.norm[q][:, None], most[None, :], gap)
            for t in np.argsort(-upper.max(0), kind="stable"):
                here = a + np.flatnonzero(upper[:, t] >= self.least[q])
                if len(here):
                    c = slice(starts[t], starts[t] + TILE)
                    self._tile(here, ids[c], v[c], far[c], norm[c], exact)

    def _tile(self, here: np.ndarray, ids: np.ndarray, v: np.ndarray, far: np.ndarray, norm: np.ndarray, exact: bool) -> None:
        gap = np.zeros((len(here), len(ids)))
        for p in range(far.shape[1]):
            np.maximum(gap, np.abs(far[:, p][None, :] - self.far[here, p][:, None]), out=gap)
        may = (_upper(self.norm[here][:, None], norm[None, :], gap) >= self.least[here][:, None]) & (ids[None, :] != self.ids[here][:, None])
        queries, candidates = may.any(1), may.any(0)
        here, may, ids = here[queries], may[np.ix_(queries, candidates)], ids[candidates]
        if not len(here):
            return
        score = np.where(may, products(self.v[here], v[candidates], exact), LEAST)
        better = (may & (score >= self.least[here][:, None])).any(1)
        here, score = here[better], score[better]
        score = np.hstack((self.best[here], score))
        who = np.hstack((self.who[here], np.broadcast_to(ids, (len(here), len(ids)))))
        order = np.lexsort((who, ~score), axis=1)[:, : self.k]
        self.best[here], self.who[here] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        self.least[here] = np.maximum(self.least[here], self.best[here, self.k - 1])


def _upper(q_norm: np.ndarray, c_norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products; rounding never makes one too low."""
    total = q_norm + c_norm
    return (total - gap**2) / 2 + 1e-9 * total + 1e-6


def top_k(rows: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, rows of (vec_id, embedding) whose vec_id is divisible by `every`."""
    spark = rows.sparkSession
    vectors = materialize(integers(rows))
    is_query = F.col("vec_id") % every == 0
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("vec_id"), "vec_id"))
    common = vectors.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).where("queries > 0").orderBy(F.desc("rows"), "n")
    bytes_before = F.sum(F.col("n") * 8 * (SAMPLE + pivots)).over(Window.orderBy(F.desc("rows"), "n").rowsBetween(Window.unboundedPreceding, 0))
    chosen = common.limit(10_000).withColumn("bytes", bytes_before).where(F.col("bytes") <= PIVOT_BYTES).select("n")
    sampled = vectors.join(F.broadcast(chosen), "n").withColumn("place", place).where(F.col("place") <= max(SAMPLE, pivots)).select("n", "place", "vec_id", "v").toArrow()
    samples = {}
    for n in set(sampled.column("n").to_pylist()):
        mine = sampled.filter(pc.equal(sampled.column("n"), n)).sort_by("place")
        samples[n] = (mine.column("vec_id").to_numpy(), matrix(mine.column("v"), n, np.int64))
    shared = spark.sparkContext.broadcast(samples)

    def tabled(batches):
        for batch in batches:
            t, lengths = pa.Table.from_batches([batch]), np.unique(batch.column(2).to_numpy())
            for n in lengths.tolist():
                mine = t.filter(pc.equal(t.column(2), n))
                v = matrix(mine.column(1), n, np.int64)
                far = distances(v, shared.value[n][1][:pivots]) if n in shared.value else np.zeros((len(v), 1))
                splits = pa.array(np.arange(len(v) + 1, dtype=np.int32) * far.shape[1])
                columns = [mine.column(c).combine_chunks() for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(splits, pa.array(far.reshape(-1))), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], names=["vec_id", "v", "n", "far", "cell", "near"])

    laid = vectors.mapInArrow(tabled, "vec_id long, v array<long>, n int, far array<double>, cell int, near double")
    compared = laid.join(F.broadcast(common.select("n")), "n", "left_semi") if common.count() <= 10_000 else laid
    order = ["n", "cell", "near", "vec_id"]
    laid = materialize(compared.repartitionByRange(*order).sortWithinPartitions(*order))

    queries = vectors.where(is_query)
    size = queries.agg(F.sum(F.col("n").cast("long") * 8)).first()[0] or 0
    passes = int(size // QUERY_BYTES) + 1
    found = []
    for number in range(passes):
        asked = queries.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(passes)) == number).select("vec_id", "v", "n").toArrow()  # QUERY_BYTES, about
        if not asked.num_rows and passes > 1:
            continue
        sent = spark.sparkContext.broadcast(asked)
        found.append(materialize(laid.mapInArrow(_searcher(sent, shared, number, pivots, k), "query_id long, row long, vec_id long, score long")))
        sent.unpersist()
    near = found[0]
    for more in found[1:]:
        near = near.union(more)
    discard(vectors, laid)
    place = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, shared, number: int, pivots: int, k: int):
    """A task of one pass: blocks of candidates in, each query's best of all of them out."""

    def searches() -> dict[int, tuple[np.ndarray, Search]]:
        asked, out = sent.value, {}
        lengths = asked.column("n").to_numpy()
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            mine = asked.take(pa.array(at))
            ids, sample = shared.value.get(n, (np.zeros(0, np.int64), np.zeros((0, n), np.int64)))
            points = sample[:pivots] if len(sample) else np.zeros((1, n))
            search = Search(mine.column("vec_id").to_numpy(), matrix(mine.column("v"), n, np.int64), points, ids, sample, k)
            if not len(sample):
                search.far[:] = 0  # no pivots: no bound
            out[n] = (at, search)
        return out

    def run(batches):
        open_ = None

        def look(held):
            t = pa.Table.from_batches(held)
            for n in np.unique(t.column("n").to_numpy()).tolist():
                if n in open_:
                    mine = t.filter(pc.equal(t.column("n"), n))
                    far = pc.list_flatten(mine.column("far")).to_numpy().reshape(mine.num_rows, -1)
                    open_[n][1].see(mine.column("vec_id").to_numpy(), matrix(mine.column("v"), n, np.int64), far)

        held, rows = [], 0
        for batch in batches:
            open_ = open_ or searches()
            for i in range(0, batch.num_rows, TILE * TILES):
                held.append(batch.slice(i, TILE * TILES))
                rows += held[-1].num_rows
                if rows >= TILE * TILES:
                    look(held)
                    held, rows = [], 0
        if held:
            look(held)
        for at, search in (open_ or {}).values():
            i, j = np.nonzero(search.best > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[i]), pa.array(at[i] + (number << 32)), pa.array(search.who[i, j]), pa.array(search.best[i, j])], names=["query_id", "row", "vec_id", "score"])

    return run
