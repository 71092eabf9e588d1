"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its k-word shingles (A-Z lowered, white-space words); documents are linked if their sets'
Jaccard similarity is at least `percent`/100, and a group is a connected component of links.

1. Documents of one word sequence (by a 128-bit cryptographic digest of the whole sequence) are one class, with its
   smallest doc_id; only classes are joined. Equal sets of other sequences are linked like any other pair.
2. A class posts itself under the values of each run of coordinates of its signature of POSTED minima (3 coordinates at
   80 %: `runs(percent)` takes the longest that leave something to skip). Single values are shared by a part of all
   classes, as frequent words are, so their lists grow with the square of the corpus; whole runs hardly are by chance.
   A pair is retained if it collides in at least `matches(percent)` of the first COORDINATES, which linked pairs do but
   for a chance of MISSED.
3. Prefix and skip: postings are ordered by frequency. Linked pairs agree in at least `runs(percent)[1]` runs but for a
   chance of MISSED, so a class skips all but one of so many, its most frequent ones: two linked classes still meet
   under a rarer one. Runs that nobody shares post nothing, and runs that a passage or frequent words give to very many
   classes are those skipped.
4. Lists aren't expanded into their pairs. Every class of a list meets STARS of its members, its pivots. The lists of
   one first pivot are then taken as one: if all its classes are connected with it, it is done; else each class outside
   the pivot's component meets the others that aren't in its own component, in blocks of both sides for large groups.
   Two linked classes share a first pivot, so they are connected already or meet.
5. Each meeting counts the pair's collisions over COORDINATES, the skipped ones too: a class carries four bits of
   each of these coordinates' values, so the count is never below the true one. Pairs below the match threshold make no row, nor do
   pairs ruled out by their sizes, by their distances to the pivot (1 - similarity is a metric), or by an odd sketch of
   ODD_BITS bits, in which each shingle flips one bit, so that two sketches never differ in more bits than the sets
   differ in shingles. What is left is verified on the whole sets of words, made again from the texts.
6. Components by label propagation with pointer jumping, as joins.

Heavy keys (a pivot, a class or a document with very many rows) are dealt to several tasks in each join.

Null or empty text: an empty set, linked with nothing. Fewer words than k: the whole sequence is one shingle. Null
doc_id: linked with nothing, component_id null, kept. Repeated rows: one result row each; rows that share a doc_id are
one document with each of their sets, in one component. Empty table: no rows. Extra columns are ignored.
one_of_each works on rows instead: equal, repeated and null ids don't matter, and one row of each component stays.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_TEXT, chunks, column_bytes, discard, exact_shingles, heavy_join, heavy_keys, map_batches, materialize, minima, mix, only, overlap, shingles_of, sizes_of, slices, small, stream

#: Coordinates whose collisions are counted; coordinates that runs are made of, the counted ones first.
COORDINATES = 64
POSTED = 96
#: The chance that a pair at the threshold itself collides less often than the match threshold; the same for runs.
MISSED = 2e-6
#: Pivots of a list.
STARS = 3
#: Bits of the odd sketches.
ODD_BITS = 2048
#: Classes of a group that meet in one block, on either side.
BLOCK_CLASSES = 512


def _fewest(p: float, n: int) -> int:
    """The most collisions that n independent chances of p miss with a chance up to MISSED."""
    below, m = 0.0, 0
    while m < n and (below := below + comb(n, m) * p**m * (1 - p) ** (n - m)) <= MISSED:
        m += 1
    return m


def matches(percent: int) -> int:
    """The match threshold: the most collisions that a pair of similarity percent / 100 misses with a chance up to MISSED."""
    m = _fewest(percent / 100, COORDINATES)
    if m < 1 or percent > 100:
        raise ValueError(f"percent {percent}: {COORDINATES} coordinates find similarities from 0.2 to 1")
    return m


def runs(percent: int) -> tuple[int, int]:
    """Coordinates of a run (the most of which a linked pair shares two runs at least, else 1), and how many runs it shares."""
    length = max((r for r in range(1, 9) if _fewest((percent / 100) ** r, POSTED // r) > 1), default=1)
    return length, _fewest((percent / 100) ** length, POSTED // length)


def signatures(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the word sequence), tokens (a hash of each run and its values), s0..s3 (bit j of each counted coordinate's value)."""
    a = stream(21, POSTED) | np.uint64(1)
    b = stream(22, POSTED)
    salt = stream(23, POSTED)
    length = runs(percent)[0]
    weight = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)

    def work(batch):
        texts = column_bytes(batch.column(1))
        n, d1, d2, tokens, sketch = [], [], [], [], [[], [], [], []]
        for lo, hi in chunks(texts):
            digests: list[bytes] = []
            h, at = shingles_of(texts[lo:hi], k, digests=digests)
            sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(hi - lo)]
            sizes = np.array([len(x) for x in sets])
            full = np.flatnonzero(sizes)
            n += sizes.tolist()
            two = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            d1 += two[:, 0].tolist()
            d2 += two[:, 1].tolist()
            sig = np.zeros((hi - lo, POSTED), dtype=np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full]) if hi - lo > 1 else sets[0]
                begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for c in range(POSTED):
                    sig[full, c] = minima(flat, begins, a[c], b[c])
            pairs = mix(sig + salt[None, :])
            run = np.zeros((hi - lo, POSTED // length), dtype=np.uint64)
            for c in range(length):  # values hold their coordinate by its salt
                run = mix(run * np.uint64(0xD6E8FEB86659FD93) + pairs[:, c : POSTED // length * length : length])
            tokens += [x.view(np.int64) if m else np.zeros(0, np.int64) for x, m in zip(run, sizes, strict=True)]
            for j in range(4):
                bits = (pairs[:, :COORDINATES] >> np.uint64(11 + 9 * j)) & np.uint64(1)
                sketch[j] += (bits * weight).sum(1, dtype=np.uint64).view(np.int64).tolist()
        return {"doc_id": batch.column(0), "n": n, "d1": d1, "d2": d2, "tokens": tokens} | {f"s{j}": sketch[j] for j in range(4)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n long, d1 long, d2 long, tokens array<long>, " + ", ".join(f"s{j} long" for j in range(4)))


def _retained(a: str, b: str, percent: int) -> Column:
    """The sizes allow the similarity, and the pair collides in as many coordinates as the match threshold asks for."""
    unequal = F.lit(0).cast("long")
    for j in range(4):
        unequal = unequal.bitwiseOR(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}")))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (COORDINATES - F.bit_count(unequal) >= matches(percent))


def odd_sketches(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, q0..q31) of (doc_id, text): the set's size and its odd sketch."""
    names = [f"q{j}" for j in range(ODD_BITS // 64)]
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def work(batch):
        part = column_bytes(batch.column(1))
        n, rows = [], []
        for lo, hi in chunks(part):
            h, at = shingles_of(part[lo:hi], k)
            for i in range(hi - lo):
                mine = np.unique(h[at[i] : at[i + 1]])
                n.append(len(mine))
                odd = np.bincount((mix(mine + np.uint64(3)) % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS).astype(np.uint64) & np.uint64(1)
                rows.append((odd.reshape(-1, 64) * weight).sum(1, dtype=np.uint64).view(np.int64))
        table = np.array(rows).reshape(len(part), -1)
        return {"id": batch.column(0), "n": n} | {q: table[:, j] for j, q in enumerate(names)}

    return map_batches(texts.select("doc_id", "text"), work, "id long, n long, " + ", ".join(f"{q} long" for q in names))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = materialize(ids)
    out = materialize(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted))
    discard(wanted)
    return out


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, d, linked) of pairs (a, b; materialised): their whole sets' distance, and whether they have the similarity; texts come by joins on a and b."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    of = lambda c, t: texts.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    both = heavy_join(pairs.select("a", "b"), of("b", "tb"), ["b"], heavy_keys(sizes_of(pairs, "b"), ["b"]))
    both = heavy_join(both, of("a", "ta"), ["a"], heavy_keys(sizes_of(pairs, "a"), ["a"])).select("a", "b", "ta", "tb")

    def run(batches):
        last: tuple = (None, set())
        for batch in slices(batches):
            distance, linked = [], []
            for x, y in zip(column_bytes(batch.column(2)), column_bytes(batch.column(3)), strict=True):
                if max(len(x), len(y)) > LONG_TEXT:
                    shared, union = overlap(x, y, k)
                else:
                    if x != last[0]:
                        last = (x, exact_shingles(x, k))
                    other = exact_shingles(y, k)
                    shared = len(last[1] & other)
                    union = len(last[1]) + len(other) - shared
                distance.append(1 - shared / max(union, 1))
                linked.append(bool(shared) and 100 * shared >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

    found = both.mapInArrow(run, "a long, b long, d double, linked boolean")
    # a repeated doc_id has several sets: then no one distance holds
    out = materialize(found.groupBy("a", "b").agg(F.when(F.min("d") == F.max("d"), F.min("d")).alias("d"), F.max("linked").alias("linked")))
    discard(texts)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b), once: component is the smallest id reachable."""
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select(F.col("u").alias("id"), F.least("u", "least").alias("c"), "n"))
    heavy = heavy_keys(labels.select(F.col("id").alias("v"), "n"), ["v"])
    labels = labels.drop("n")
    while True:
        near = heavy_join(edges, labels.select(F.col("id").alias("v"), "c"), ["v"], heavy).groupBy(F.col("u").alias("id")).agg(F.min("c").alias("m"))
        step = materialize(labels.join(near, "id").select("id", F.least("c", "m").alias("c"), F.col("c").alias("old")))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
        new = materialize(heavy_join(step, jump, ["c"], heavy_keys(sizes_of(step, "c"), ["c"]), "left").select("id", F.least(F.col("c"), F.coalesce("further", "c")).alias("c"), "old"))
        discard(step)
        labels = new.select("id", "c")
        if new.where(F.col("c") != F.col("old")).isEmpty():
            discard(edges)
            return labels.select("id", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    base = materialize(signatures(docs, k, percent))
    usable = base.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    key = ["d1", "d2"]
    classes = materialize(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), *(F.first(f"s{j}").alias(f"s{j}") for j in range(4))))
    posted = classes.select("rep", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("df"), "token"))
    rarer = posted.join(shared, "token").withColumn("rank", rank).where(F.col("rank") >= runs(percent)[1])
    sketch = classes.select("rep", "n", *(f"s{j}" for j in range(4)))
    lists = materialize(rarer.select("token", "rep").join(sketch, "rep"))
    stars = None
    for star in range(STARS):
        order = F.col("rep") if star == 0 else F.xxhash64(F.lit(star), "rep")
        pivot = F.min(F.struct(order.alias("o"), "rep", "n", *(f"s{j}" for j in range(4)))).alias("p")
        pivots = lists.groupBy("token").agg(pivot, F.count("*").alias("size")).where(F.col("size") > 1).select("token", "p.rep", "p.n", *(f"p.s{j}" for j in range(4)))
        met = lists.alias("x").join(pivots.alias("y"), "token").where(F.col("x.rep") != F.col("y.rep"))
        met = met.select(F.lit(star).alias("star"), F.col("y.rep").alias("pivot"), F.col("x.rep").alias("rep"), _retained("x", "y", percent).alias("retained")).distinct()
        stars = met if stars is None else stars.union(met.where("retained"))
    stars = materialize(stars)
    discard(lists)
    pair = [F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")]
    first = materialize(stars.where("retained").select(*pair).distinct())
    tested = verified(first, docs, k, percent)
    members = materialize(heavy_join(usable.select("doc_id", *key), classes.select(*key, "rep"), key, heavy_keys(classes.select(*key, F.col("size").alias("n")), key)).select("doc_id", "rep").distinct())
    links = materialize(tested.where("linked").select("a", "b").union(_same_id(members)))
    links = links.union(_outside(stars.where("star = 0").select("pivot", "rep"), tested, components(links), sketch, docs, k, percent))
    of_class = classes.select(*key, "rep", "size").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select(*key, "size", F.coalesce("component", "rep").alias("component"))
    of_class = materialize(of_class)
    discard(stars, first, members)
    heavy = heavy_keys(of_class.select(*key, F.col("size").alias("n")), key)
    rows = heavy_join(base.select("doc_id", F.col("n").alias("n_shingles"), *key), of_class.drop("size"), key, heavy, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(members: DataFrame) -> DataFrame:
    """Links (a, b) of the classes that hold one doc_id; members: (doc_id, rep), each once."""
    several = materialize(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc_id", "a"))
    return members.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def _outside(groups: DataFrame, tested: DataFrame, found: DataFrame, sketch: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of the classes of groups (pivot, rep) that aren't in their pivot's component, with others of the group."""
    label = found.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    of_pivot = found.select(F.col("id").alias("pivot"), F.col("component").alias("pc"))
    heavy = heavy_keys(sizes_of(groups, "pivot"), ["pivot"])
    known = tested.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "d")  # a first pivot is the smallest id of its lists
    rows = heavy_join(groups.join(label, "rep", "left"), of_pivot, ["pivot"], heavy, "left").join(known, ["pivot", "rep"], "left")
    rows = rows.select("pivot", "rep", F.coalesce("c", "rep").alias("c"), F.coalesce("pc", "pivot").alias("pc"), "d")
    rows = materialize(rows.withColumn("out", F.col("c") != F.col("pc")))
    open_groups = materialize(rows.groupBy("pivot").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count("*").alias("size")).where("n_out > 0 and size > 1").select("pivot", F.ceil(F.col("n_out") / BLOCK_CLASSES).cast("int").alias("xs"), F.ceil(F.col("size") / BLOCK_CLASSES).cast("int").alias("ys")))
    rows = materialize(heavy_join(rows, open_groups, ["pivot"], heavy))
    ids = rows.select(F.col("rep").alias("doc_id")).distinct()
    texts = texts_of(docs, ids)
    odd = odd_sketches(texts, k)
    rows = materialize(rows.join(odd, F.col("rep") == F.col("id")).drop("id").join(sketch.drop("n"), "rep"))
    discard(texts)
    # a group's blocks: x rows fall into one of xs, y rows into one of ys, and each block of x meets each of y
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where("out").withColumn("i", part("xs", 1)).withColumn("j", every("ys")).alias("x")
    y = rows.withColumn("j", part("ys", 2)).withColumn("i", every("xs")).alias("y")
    differ = F.lit(0)
    for j in range(ODD_BITS // 64):
        differ = differ + F.bit_count(F.col(f"x.q{j}").bitwiseXOR(F.col(f"y.q{j}")))
    near = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    once = ~F.col("y.out") | (F.col("x.rep") < F.col("y.rep"))
    may = (F.col("x.c") != F.col("y.c")) & (F.col("x.rep") != F.col("y.rep")) & once & near & _retained("x", "y", percent)
    block = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    meet = x.join(y, block & may & (differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)))
    pairs = materialize(meet.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    out = verified(pairs, docs, k, percent).where("linked").select("a", "b")
    discard(rows)
    return out


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all its columns, with one row of each component of rows: the one with the smallest doc_id (nulls last, ties: any)."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = materialize(near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("r"), "component_id"))
    # only components of several rows are ranked: each has a row that isn't its first
    several = materialize(found.where("r != component_id").select("component_id").distinct())
    theirs = heavy_join(found, small(several), ["component_id"], heavy_keys(sizes_of(found, "component_id"), ["component_id"]))
    ids = numbered.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("doc_id"))
    ranked = materialize(theirs.join(ids, "r").select("r", "component_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r").alias("place")))
    first = ranked.groupBy("component_id").agg(F.min("place").alias("first")).select("first.r")
    gone = materialize(ranked.select("r").join(materialize(first), "r", "left_anti").withColumnRenamed("r", row))
    return numbered.join(small(gone), row, "left_anti").select(*docs.columns)
