"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes and one end sign, each predicted from the DEPTH bytes before it (end signs stand before the
first). A byte is eight binary decisions; each has its own context tree with Krichevsky-Trofimov estimates at every
depth, and the weighted probability of a node is half its own estimate's plus half the product of its children's. Every
context of the training texts is a node, so the tree grows with the corpus; what training never saw has 1/2. The trained
weights are then fixed: a byte's probability is the mixture over all depths of its context path, a text's score its sum
of log10.

The tree is a table, never held in one place. One pass counts (context, byte) over all training texts (keys of other
texts enter with 0). Subtrees below a three-byte context are weighted where they lie; their roots are weighted by their
last byte; the 256 results meet on the driver; then the mixtures are handed down the same way, to a log10 for each key. A
subtree's size is bounded by the alphabet, not by the corpus.

Base scores need every token's count. Tokens are hashed to 64 bits. The FREQUENT keys and the FREQUENT tokens that occur
most often are broadcast, all others are joined.

Null or empty text: the end sign alone. Null doc_id: not held out, learned from. Repeated rows: one result row each, and
learned from as often. Very long texts: taken in pieces. Empty table: no rows. Nothing to learn from: every binary
decision has 1/2. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import chunks, column_bytes, materialize, slices, stream, words_of
from .labelled import crc_of

DEPTH = 5
#: Depths at which the tree is cut into subtrees: below the second, between both, above the first.
CUT = (1, 3)
#: Keys, and tokens, that may be broadcast with their values (up to 64 bytes each, as a hash table).
FREQUENT = 1 << 20
END = 0xFF  # never a byte of UTF-8
END_TOKEN = int(stream(41, 1).view(np.int64)[0])
#: Distinct keys that a counting task holds before it passes them on.
HELD = 500_000
#: Keys, or rows of three-byte contexts, that are weighted at once; a subtree is never divided.
KEYS_AT_ONCE, ROWS_AT_ONCE = 1 << 17, 1 << 9
LN2 = float(np.log(2))


# --- counting ---------------------------------------------------------------------------------------------


def _keys(buf: np.ndarray) -> np.ndarray:
    """For each byte of buf from place DEPTH on: the DEPTH bytes before it, nearest first, and itself, as one number."""
    wide = buf.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= wide[DEPTH - d : len(buf) - d] << np.uint64(8 * (DEPTH + 1 - d))
    return key


def context_keys(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, text number of each) of the predicted bytes of all texts, a block at a time."""
    gap = bytes([END]) * DEPTH
    for lo, hi in chunks(texts):
        if hi - lo == 1:
            data = gap + texts[lo] + gap[:1]
            for at in range(DEPTH, len(data), common.CHUNK):
                key = _keys(np.frombuffer(data[at - DEPTH : at + common.CHUNK], dtype=np.uint8))
                yield key, np.full(len(key), lo)
        else:
            key = _keys(np.frombuffer(gap + gap.join(texts[lo:hi]) + gap[:1], dtype=np.uint8))
            lengths = np.fromiter(map(len, texts[lo:hi]), dtype=np.int64, count=hi - lo) + 1
            doc = np.repeat(np.arange(hi - lo), lengths)
            yield key[np.arange(len(doc)) + doc * (DEPTH - 1)], doc + lo


class Tally:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.pending, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
        counts = np.concatenate([self.counts, *(c for _, c in self.pending)])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(place, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.pending, self.size = [], 0

    def batches(self, kind: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.merge()
        for i in range(0, len(self.keys), 200_000):
            k = self.keys[i : i + 200_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int32)), pa.array(k), pa.array(self.counts[i : i + 200_000])], schema=schema)
        self.__init__()


def counted(rows: DataFrame) -> DataFrame:
    """(kind, key, n) of rows (text, held_out), pre-aggregated: kind 0 counts (context, byte) in training texts, others' with 0; kind 1 tokens of training texts."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        tallies = [Tally(), Tally()]
        for batch in slices(batches):
            texts, held = column_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=bool)
            for keys, doc in context_keys(texts):
                for part, weight in ((keys[~held[doc]], 1), (keys[held[doc]], 0)):
                    found, n = np.unique(part, return_counts=True)
                    tallies[0].add(found, n * weight)
            training = [t for t, h in zip(texts, held, strict=True) if not h]
            for lo, hi in chunks(training):
                ends = np.full(hi - lo, np.array(END_TOKEN).astype(np.int64).view(np.uint64), dtype=np.uint64)
                tallies[1].add(*np.unique(np.concatenate((words_of(training[lo:hi])[0], ends)), return_counts=True))
            for kind, tally in enumerate(tallies):
                if len(tally.keys) > HELD:
                    yield from tally.batches(kind, schema)
        for kind, tally in enumerate(tallies):
            yield from tally.batches(kind, schema)

    return rows.select("text", "held_out").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the tree ---------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after shifting x by 8."""
    y = x + 8
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones; 0 for none."""
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002
    return np.where(zeros + ones > 0, out, 0.0)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Depth:
    """Nodes of one depth: sorted codes, their counts of zeros and ones, and after weigh() their weighted log probabilities and own shares."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.code, self.zeros, self.ones = code, zeros, ones
        self.own = self.weighted = kt(zeros, ones)

    def weigh(self, below: np.ndarray) -> None:
        """below: the sum of the children's weighted log probabilities."""
        self.weighted = np.logaddexp(self.own, below) - LN2
        self.share = np.exp(np.minimum(self.own - LN2 - self.weighted, 0))

    def mixed(self, above: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the path down to each node has mixed, and the weight that is left for deeper nodes."""
        return above + left * self.share * estimate(self.zeros, self.ones), left * (1 - self.share)


def parents(child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Places in parent (sorted) of each child's parent code."""
    return np.searchsorted(parent, child)


class Leaves:
    """Subtrees below three-byte contexts, from sorted keys and their counts; decisions of one level (known bits) at a time."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        self.contexts, self.symbols, self.n, self.up = {}, {}, {}, {}
        for d in range(DEPTH, CUT[1] - 1, -1):
            pair = ((keys >> (8 * (DEPTH + 1 - d))) << 8) | (keys & 255)
            pair, place = np.unique(pair, return_inverse=True) if d < DEPTH else (pair, np.arange(len(pair)))
            context, self.symbols[d] = pair >> 8, pair & 255
            self.n[d] = np.bincount(place, weights=n, minlength=len(pair))
            self.contexts[d], self.up[d] = np.unique(context, return_inverse=True)

    def level(self, known: int) -> tuple[dict[int, Depth], dict[int, np.ndarray], np.ndarray]:
        """Depths of the decisions after `known` bits, weighted; each node's parent; each key's node."""
        depths, parent, mask = {}, {}, (1 << known) - 1
        for d in range(DEPTH, CUT[1] - 1, -1):
            code = (self.up[d] << known) | (self.symbols[d] >> (8 - known))
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            ones = self.n[d] * ((self.symbols[d] >> (7 - known)) & 1)
            depths[d] = Depth(code[first], np.add.reduceat(self.n[d] - ones, first), np.add.reduceat(ones, first))
            if d == DEPTH:
                node = np.cumsum(np.concatenate(([0], code[1:] != code[:-1])))
        for d in range(DEPTH, CUT[1], -1):
            of = np.searchsorted(self.contexts[d - 1], self.contexts[d] >> 8)
            parent[d] = parents((of[depths[d].code >> known] << known) | (depths[d].code & mask), depths[d - 1].code)
            depths[d - 1].weigh(np.bincount(parent[d], weights=depths[d].weighted, minlength=len(depths[d - 1].code)))
        return depths, parent, node

    def roots(self) -> tuple[np.ndarray, ...]:
        """(context, decision, zeros, ones, weighted) of the subtrees' roots; a decision is 1 and the known bits. Sorted by context."""
        found = []
        for known in range(8):
            top = self.level(known)[0][CUT[1]]
            found.append((self.contexts[CUT[1]][top.code >> known], (1 << known) | (top.code & ((1 << known) - 1)), top.zeros, top.ones, top.weighted))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)

    def log10(self, code: np.ndarray, above: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of each key's probability, from what is mixed above each root (code: context << 8 | decision, sorted)."""
        total = np.zeros(len(self.keys))
        for known in range(8):
            depths, parent, node = self.level(known)
            top = depths[CUT[1]]
            at = np.searchsorted(code, (self.contexts[CUT[1]][top.code >> known] << 8) | (1 << known) | (top.code & ((1 << known) - 1)))
            a, rest = top.mixed(above[at], left[at])
            for d in range(CUT[1] + 1, DEPTH):
                a, rest = depths[d].mixed(a[parent[d]], rest[parent[d]])
            last = depths[DEPTH]
            one = np.clip(a[parent[DEPTH]] + rest[parent[DEPTH]] * estimate(last.zeros, last.ones), 1e-12, 1 - 1e-12)[node]
            total += np.log10(np.where((self.symbols[DEPTH] >> (7 - known)) & 1, one, 1 - one))
        return total


class Middle:
    """Nodes between the cuts, from the (context, decision, zeros, ones, weighted) of three-byte contexts."""

    def __init__(self, context, decision, zeros, ones, weighted):
        self.context, self.decision = context, decision
        self.depths, self.parent = {}, {}
        for d in range(CUT[1] - 1, CUT[0] - 1, -1):
            context = context >> 8
            code, place = np.unique((context << 8) | decision, return_inverse=True)
            add = lambda x, n=len(code), place=place: np.bincount(place, weights=x, minlength=n)
            zeros, ones, below = add(zeros), add(ones), add(weighted)
            self.depths[d], self.parent[d + 1] = Depth(code, zeros, ones), place
            self.depths[d].weigh(below)
            context, decision, weighted = code >> 8, code & 255, self.depths[d].weighted

    def roots(self) -> tuple[np.ndarray, ...]:
        top = self.depths[CUT[0]]
        return top.code >> 8, top.code & 255, top.zeros, top.ones, top.weighted

    def handed(self, above: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is mixed above each three-byte context's decisions, from the same by decision above the top."""
        at = self.depths[CUT[0]].code & 255
        a, rest = above[at], left[at]
        for d in range(CUT[0], CUT[1]):
            a, rest = self.depths[d].mixed(a, rest)
            a, rest = a[self.parent[d + 1]], rest[self.parent[d + 1]]
        return a, rest


def whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about size rows of batches sorted by their first column; no group of equal values is divided."""
    held, n, least = [], 0, size
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held)
            group = table.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
            least = max(size, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _flat(table: pa.Table, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values of the first column for each element of the list columns, and the elements."""
    lengths = pc.list_value_length(table.column(names[0])).to_numpy()
    return np.repeat(table.column(0).to_numpy(), lengths), [pc.list_flatten(table.column(c)).to_numpy() for c in names]


def _lists(group: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each value of group (sorted), with lists of the columns' elements."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, int)
    splits = pa.array(np.concatenate((first, [len(group)])).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(group[first]), *(pa.ListArray.from_arrays(splits, pa.array(c)) for c in columns)], names=names)


_ROOTS = ["d", "zeros", "ones", "weighted"]
_ROOTS_SCHEMA = "g long, d array<long>, zeros array<double>, ones array<double>, weighted array<double>"


def key_values(counts: DataFrame) -> DataFrame:
    """(key, n, value) of counts (key, n; each key once): log10 of the byte's probability in its context."""
    keyed = counts.select(F.shiftrightunsigned("key", 8 * (DEPTH + 1 - CUT[1])).alias("g"), "key", F.col("n").cast("double").alias("n"))

    def leaf_roots(batches):
        for t in whole_groups(batches, KEYS_AT_ONCE):
            context, *rest = Leaves(t.column("key").to_numpy(), t.column("n").to_numpy()).roots()
            yield _lists(context, rest, ["g", *_ROOTS])

    def middle(t: pa.Table) -> Middle:
        decisions, columns = _flat(t.select(["c", *_ROOTS]), _ROOTS)
        return Middle(decisions, *columns)

    def middle_roots(batches):
        for t in whole_groups(batches, ROWS_AT_ONCE):
            context, *rest = middle(t).roots()
            yield _lists(context, rest, ["g", *_ROOTS])

    subtrees = materialize(keyed.repartition("g").sortWithinPartitions("g", "key").mapInArrow(leaf_roots, _ROOTS_SCHEMA))
    by_last = subtrees.select(F.shiftrightunsigned("g", 8 * (CUT[1] - CUT[0])).alias("top"), F.col("g").alias("c"), *_ROOTS).repartition("top").sortWithinPartitions("top", "c")
    tops = by_last.mapInArrow(middle_roots, _ROOTS_SCHEMA).toArrow()  # 256 rows of 255 elements at most
    _, (decision, zeros, ones, weighted) = _flat(tops, _ROOTS) if tops.num_rows else (None, [np.zeros(0)] * 4)
    add = lambda x: np.bincount(decision.astype(np.int64), weights=x, minlength=256)
    root = Depth(np.arange(256), add(zeros), add(ones))
    root.weigh(add(weighted))
    above, left = root.mixed(np.zeros(256), np.ones(256))

    def hand_down(batches):
        for t in whole_groups(batches, ROWS_AT_ONCE):
            nodes = middle(t)
            a, rest = nodes.handed(above, left)
            yield _lists(nodes.context, [nodes.decision, a, rest], ["g", "d", "above", "left"])

    handed = by_last.mapInArrow(hand_down, "g long, d array<long>, above array<double>, left array<double>")
    lists = {"d": "array<long>", "above": "array<double>", "left": "array<double>"}
    both = keyed.select("g", "key", "n", *(F.lit(None).cast(t).alias(c) for c, t in lists.items())).union(handed.select("g", F.lit(None).cast("long"), F.lit(None).cast("double"), *lists))

    def leaf_values(batches):
        for t in whole_groups(batches, KEYS_AT_ONCE):
            t = t.combine_chunks()
            is_key = pc.is_valid(t.column("key"))
            own, given = t.filter(is_key), t.filter(pc.invert(is_key))
            context, (decision, a, rest) = _flat(given.select(["g", *lists]), list(lists))
            code = (context << 8) | decision
            order = np.argsort(code)
            keys, n = own.column("key").to_numpy(), own.column("n").to_numpy()
            value = Leaves(keys, n).log10(code[order], a[order], rest[order])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), pa.array(value)], names=["key", "n", "value"])

    return materialize(both.repartition("g").sortWithinPartitions("g", "key").mapInArrow(leaf_values, "key long, n long, value double"))


# --- scores -----------------------------------------------------------------------------------------------


class Table:
    """64-bit keys -> values by two choices of a slot; what finds no slot is kept in sorted order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.slots = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.values = np.full(len(self.slots), np.nan)
        rest = np.arange(len(keys))
        for turn in (0, 1):
            slot = self._slot(keys[rest], turn)
            free = np.isnan(self.values[slot])
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[slot[put]], self.values[slot[put]] = keys[rest[put]], values[rest[put]]
            rest = np.delete(rest, put)
        order = np.argsort(keys[rest])
        self.odd_keys, self.odd_values = keys[rest][order], values[rest][order]

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        spread = keys * np.uint64(0x9E3779B97F4A7C15 if turn else 0xD6E8FEB86659FD93)
        return (spread >> np.uint64(32)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; nan where there is none."""
        out = np.full(len(keys), np.nan)
        left = np.arange(len(keys))
        for turn in (0, 1):
            slot = self._slot(keys[left], turn)
            hit = (self.slots[slot] == keys[left]) & ~np.isnan(self.values[slot])
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit]
        if len(self.odd_keys) and len(left):
            place = np.minimum(np.searchsorted(self.odd_keys, keys[left]), len(self.odd_keys) - 1)
            hit = self.odd_keys[place] == keys[left]
            out[left[hit]] = self.odd_values[place[hit]]
        return out


def most_frequent(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """(keys, values) of at most FREQUENT of rows (key, n, value; materialised) with the highest n, and the others."""
    bucket = F.floor(F.log2(F.col("n") + 1.0) * 16)
    least, total = None, 0
    for r in sorted(rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True):  # about 1,000 rows at most
        total += r.n
        if total > FREQUENT:
            break
        least = r.b
    often = (bucket >= least) if least is not None else F.lit(False)
    table = rows.where(often).select("key", "value").toArrow()
    return (table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("value").to_numpy()), rows.where(~often)


class Sums:
    """Per text: the sum and number of found values, and the other keys with how often each occurs."""

    def __init__(self, table: Table, n: int):
        self.table, self.total, self.found, self.rare = table, np.zeros(n), np.zeros(n, dtype=np.int64), []

    def add(self, keys: np.ndarray, doc: np.ndarray) -> None:
        value = self.table.get(keys)
        found = ~np.isnan(value)
        self.total += np.bincount(doc[found], weights=value[found], minlength=len(self.total))
        self.found += np.bincount(doc[found], minlength=len(self.total))
        if not found.all():
            rare, of = keys[~found], doc[~found]
            order = np.lexsort((rare, of))
            rare, of = rare[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1]))))
            self.rare.append((of[first], rare[first].view(np.int64), np.diff(np.concatenate((first, [len(rare)])))))

    def lists(self) -> tuple[pa.Array, pa.Array]:
        """(keys, times) lists of each text."""
        of, rare, times = (np.concatenate([r[i] for r in self.rare] or [np.zeros(0, np.int64)]) for i in range(3))
        order = np.argsort(of, kind="stable")
        splits = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(self.total))))).astype(np.int32))
        return pa.ListArray.from_arrays(splits, pa.array(rare[order])), pa.ListArray.from_arrays(splits, pa.array(times[order].astype(np.int64)))


def score(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    held = F.coalesce(crc_of(F.col("doc_id")) % 5 == 1, F.lit(False)) if training is None else F.coalesce(~training, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    counts = materialize(counted(rows))
    tokens = counts.where("kind = 1").select("key", "n")
    total = tokens.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    n_all, floor = int(total.N or 0), int(total.N or 0) + 0.5 * (int(total.V) + 1)
    contexts = key_values(counts.where("kind = 0").select("key", "n"))
    worth = F.log10((F.col("n") + 0.5) / F.lit(floor))
    of_keys, rare_keys = most_frequent(contexts)
    of_tokens, rare_tokens = most_frequent(tokens.withColumn("value", worth))
    shared = spark.sparkContext.broadcast((Table(*of_keys), Table(*of_tokens)))
    end = np.array([END_TOKEN], dtype=np.int64).view(np.uint64)

    def run(batches):
        for batch in slices(batches):
            texts = column_bytes(batch.column(1))
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                of_context, of_token = (Sums(t, hi - lo) for t in shared.value)
                for keys, doc in context_keys(part):
                    of_context.add(keys, doc)
                h, at = words_of(part)
                n = np.diff(at)
                of_token.add(np.concatenate((h, np.repeat(end, hi - lo))), np.concatenate((np.repeat(np.arange(hi - lo), n), np.arange(hi - lo))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n + 1), pa.array(np.fromiter(map(len, part), np.int64, hi - lo)), pa.array(of_token.found), pa.array(of_token.total), pa.array(of_context.total), *of_token.lists(), *of_context.lists()],
                    names=names,
                )

    kinds = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "bytes": "long", "n_often": "long", "often": "double", "context": "double", "rare1": "array<long>", "times1": "array<long>", "rare0": "array<long>", "times0": "array<long>"}
    names = list(kinds)
    done = materialize(rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items())).withColumn("row", F.monotonically_increasing_id()))
    each = [done.select("row", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(f"rare{kind}", f"times{kind}")).alias("x")).select("row", "kind", F.col(f"x.rare{kind}").alias("key"), F.col(f"x.times{kind}").alias("times")) for kind in (0, 1)]
    values = rare_keys.select(F.lit(0).alias("kind"), "key", "value").union(rare_tokens.select(F.lit(1), "key", "value"))
    joined = each[0].union(each[1]).join(values, ["kind", "key"], "left")
    is_token = F.col("kind") == 1
    less = F.coalesce("value", F.when(is_token, F.log10(F.lit(0.5 / floor)))) * F.col("times")
    sums = joined.groupBy("row").agg(F.sum(F.when(is_token, less)).alias("less"), F.sum(F.when(~is_token, less)).alias("deeper"), F.sum(F.when(is_token & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("n_less"))
    out = done.drop("rare0", "times0", "rare1", "times1").join(sums, "row", "left")
    value = F.col("context") + F.coalesce("deeper", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_less", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("often") + F.coalesce("less", F.lit(0.0))).alias("base_score"), value.alias("score"), (-value * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
