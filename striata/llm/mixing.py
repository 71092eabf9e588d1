"""Mixing sources to target weights by weighted fair queueing.

The sources' documents stand in queues, each shuffled by a hash, and repeated up to MOST_EPOCHS times. A copy's virtual
finish time is the words of its source up to its own end, divided by the source's target. The copies of all sources,
ordered by finish time, are taken until the budget is reached: the mix ends with the last copy that doesn't exceed it.
A copy whose source has reached its target before it isn't queued, so words that one source can't give (its next
document is longer than what is left) don't go to others beyond their targets.

Nothing is sorted in one place: a source's running sum adds a window inside each (source, hash range) of about WINDOW_ROWS
documents to the sums of the ranges before it, which are themselves summed in groups of GROUP ranges; the global order is
ranges of finish time, of which only the one that holds the end is looked into; while it holds more than SORT_ROWS copies,
it is divided by ranges of the whole key again.

Sizes: white-space words (space, \\x09-\\x0D); null or empty text: 0, never taken. Null source: a source of its own, last.
Equal finish times: smaller source rank, then hash, then doc_id first. Repeated rows: each is a document of its own; rows
alike in doc_id, source and text are interchangeable. Null doc_id: kept, shuffled by the row too, as many may be alike. Very
long texts: counted in pieces. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, heavy_join, heavy_keys, materialize, pieces, slices

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size, and a document is taken as often at most.
MOST_EPOCHS = 3
#: Documents that one window holds, about; hash ranges that are summed together; ranges of finish time.
WINDOW_ROWS = 512
GROUP = 1024
TIME_RANGES = 1 << 16
#: Sources whose targets are broadcast at most; beyond, their join shuffles.
BROADCAST_SOURCES = 100_000
#: Copies around the end of the mix that one task sorts.
SORT_ROWS = 200_000


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size, salt (the text's hash) of each row of docs."""
    import pyarrow as pa

    names = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("salt", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            texts = column_bytes(batch.column(3))
            sizes = pa.array([sum(len(x.split()) for x in pieces(t)) for t in texts], type=pa.int64())
            salts = pa.array([xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes, salts], schema=names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "row long, doc_id long, source string, size long, salt long")


def shuffled(seed: int) -> Column:
    """A document's place in its source's queue: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "salt", F.when(F.col("doc_id").isNull(), F.col("row"))), 1)


def ranked(sources: DataFrame) -> DataFrame:
    """sources (materialised: source, source_size, n) with rank, from 0, by code point, null last; ranges are sorted apart."""
    spark = sources.sparkSession
    # UTF-8 binary order is code point order
    parts = materialize(sources.withColumn("last", F.col("source").isNull()).repartitionByRange(max(1, min(64, sources.count() // 10_000 + 1)), "last", "source").withColumn("part", F.spark_partition_id()))
    sizes = sorted(parts.groupBy("part").count().collect())
    start, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, start))
        start += n
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, start long")), "part").select("source", "source_size", "n", (F.col("start") + F.col("inside")).cast("long").alias("rank"))


def with_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size, rank) with target: shares by weight, none above `most` times its size, the excess reshared.

    Each round fixes the sources whose share exceeds their limit, from two sums; only sums reach the driver. Ends when a
    round fixes none (each round but the last fixes one source at least; a factor of the weights at most are of one kind).
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    rows = materialize(sources.withColumn("weight", weight).withColumn("limit", limit))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; sources with limit <= level * weight are at their limit
    while True:
        full = F.col("limit") <= level * F.col("weight")
        r = rows.agg(F.sum(F.when(full, F.col("limit"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.open or (total - (r.fixed or 0.0)) / r.open <= level * (1 + 1e-12):
            break
        level = (total - (r.fixed or 0.0)) / r.open
    return rows.withColumn("target", F.least("limit", level * F.col("weight")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, sort_rows: int = SORT_ROWS) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    return mix_sized(materialize(sized(docs)), weights, most, seed, sort_rows)


def mix_sized(rows: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, sort_rows: int = SORT_ROWS) -> DataFrame:
    sources = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    total = sources.agg(F.sum("n"), F.sum("source_size")).first()
    if not total[0]:
        return rows.select("row", "doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    not_null = lambda df: df.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranks = materialize(ranked(sources))
    targets = materialize(not_null(with_targets(ranks, weights, most)).select("name", "source_size", "target", "rank", F.ceil(F.col("n") / WINDOW_ROWS).alias("ranges")))
    few = targets.count() <= BROADCAST_SOURCES
    heavy = None if few else heavy_keys(not_null(sources).select("name", "n"), ["name"])
    # a range is a run of hashes, so the order of (range, hash) is that of the hash
    place = F.shiftright(F.shiftrightunsigned("hash", 32) * F.col("ranges"), 31)
    keyed = heavy_join(not_null(rows).withColumn("hash", shuffled(seed)), F.broadcast(targets) if few else targets, ["name"], heavy).withColumn("range", place)
    sums = keyed.groupBy("rank", "range").agg(F.sum("size").alias("in_range")).withColumn("group", F.floor(F.col("range") / GROUP))
    groups = sums.groupBy("rank", "group").agg(F.sum("in_range").alias("in_group"))
    groups = groups.select("rank", "group", (F.sum("in_group").over(Window.partitionBy("rank").orderBy("group")) - F.col("in_group")).alias("groups_before"))
    in_group = F.sum("in_range").over(Window.partitionBy("rank", "group").orderBy("range")) - F.col("in_range")
    before = sums.withColumn("ranges_before", in_group).join(groups, ["rank", "group"]).select("rank", "range", (F.col("groups_before") + F.col("ranges_before")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("rank", "range").orderBy("hash", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    at = keyed.withColumn("inside", inside).join(before, ["rank", "range"])
    queued = materialize(at.select("row", "doc_id", "source", "size", "source_size", "target", "rank", "hash", (F.col("before") + F.col("inside")).alias("end")))
    taken = _take(queued, int(total[1]), most, sort_rows)
    return queued.select("row", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _finish(epoch: int):
    """Virtual finish time of a document's copy; 1 where a source has used up its target."""
    return F.when(F.col("target") > 0, (F.col("end") + epoch * F.col("source_size")) / F.col("target"))


def _queued(epoch: int):
    """A copy's source hasn't reached its target before it."""
    return F.col("end") + epoch * F.col("source_size") - F.col("size") < F.col("target")


#: The global order of copies. Ascending nulls (doc_id) stand first.
ORDER = ("t", "rank", "hash", "doc_id", "row")


def _take(queued: DataFrame, budget: int, most: int, sort_rows: int):
    """The taken words as an expression: a copy is in if it stands before the first one that exceeds the budget."""
    counted = queued.where((F.col("size") > 0) & (F.col("target") > 0))
    copies = counted.withColumn("t", F.explode(F.array(*(F.when(_queued(e), _finish(e)) for e in range(most))))).where("t is not null")
    # Finish times over 0, divided in ranges by t / (1 + t), which is below 1.
    place = F.floor(F.col("t") / (1 + F.col("t")) * TIME_RANGES)
    by_range = copies.groupBy(place.alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # TIME_RANGES rows at most
    cut = _crossing(by_range, budget)
    if cut is None:
        return sum((F.when(_queued(e), F.col("size")).otherwise(0) for e in range(1, most)), F.when(_queued(0), F.col("size")).otherwise(0)).cast("long")
    spot, n, left = cut
    stop = _first_beyond(copies.where(place == spot).select(*ORDER, "size"), n, left, sort_rows)
    whole = F.lit(0)
    for e in range(most):
        whole = whole + F.when(_queued(e) & _before(stop, _finish(e)), F.col("size")).otherwise(0)
    return whole.cast("long")


def _crossing(parts, budget: int):
    """Of (part, words, n) the part in which the running sum of words exceeds the budget, its n, and the budget left for it; or None."""
    for r in sorted(parts):
        if r.words > budget:
            return r.part, r.n, budget
        budget -= r.words
    return None


def _first_beyond(copies: DataFrame, n: int, budget: int, sort_rows: int):
    """The first of n copies, in ORDER, at which the running sum of sizes exceeds the budget (their sum does).

    More than sort_rows copies are divided by ranges of ORDER, of which again only the crossing one is looked into: the
    whole key divides them, so copies of equal finish time never meet in one task.
    """
    while n > sort_rows:
        ranges = min(1024, -(-4 * n // sort_rows))
        parts = materialize(copies.repartitionByRange(ranges, *ORDER).withColumn("part", F.spark_partition_id()))
        sums = parts.groupBy("part").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # a row for each range
        part, n, budget = _crossing(sums, budget)
        copies = parts.where(F.col("part") == part).drop("part")
    order = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return copies.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") > budget).orderBy(*ORDER).select(*ORDER).first()


def _before(stop, t):
    """A copy of finish time t stands before stop."""
    before, same = F.lit(False), F.lit(True)
    least = -(2**63)
    for mine, its in ((t, stop.t), (F.col("rank"), stop["rank"]), (F.col("hash"), stop.hash), (F.coalesce(F.col("doc_id"), F.lit(least)), least if stop.doc_id is None else stop.doc_id), (F.col("row"), stop.row)):
        before, same = before | (same & (mine < F.lit(its))), same & (mine == F.lit(its))
    return before
