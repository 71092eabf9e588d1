"""Quality scores by Bradley-Terry pairwise ranking.

A document's raw score is w.x, where x describes its bytes (pairs of character classes) and its words (immediate
repeats, lengths). w is learned from all preference pairs (each document labelled 1 against each labelled 0): logistic
loss on the difference of their features, by Newton's method. Pairs aren't made: a pair's loss depends on two raw scores,
so a first pass counts both labels' scores in narrow bins, which gives each document the weight of all its pairs, and a
second one sums gradient and curvature over the documents. The cut is the exact quantile of all labelled documents' raw
scores, at the share of those labelled 0; scores are mapped so that it becomes CUT.

Null or empty text: scored by the features of an empty text. Null doc_id: scored; held_out is false; not learned from.
Repeated rows: one result row each; the fit takes one text for each doc_id. Very long texts: taken in pieces. Empty table: no
rows. Labels of one class only, or none: every score is the share of label 1 (none: 0.5). Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BROADCAST_ROWS, chunks, column_bytes, discard, map_batches, materialize, slices, words_of
from .labelled import crc_of, labels_by_id

#: Bins of raw scores: of this width (wider ones beyond BINS on either side of 0); pairs of bins count by the bins' mean scores.
BIN = 1 / 64
BINS = 2048
#: Coarse bins whose sums stand for the cross terms of the curvature (which steers the steps, not where they end).
COARSE = 64
#: Scores that the driver takes at once for the cut, and into how many ranges more are divided.
FEW_SCORES = 100_000
RANGES = 1024
#: The score at the quantile that divides predictions.
CUT = 0.3

# Character classes: other, lower, upper, digit, space, newline, stop, comma, ! or ?, bar, sign, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[33, 63]] = 8
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[46], _CLASS[44], _CLASS[124] = 4, 5, 6, 7, 9
_CLASS[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_/"]] = 10
_CLASS[128:] = 11
N_CLASSES = 12
N_FEATURES = N_CLASSES**2 + N_CLASSES + 6


def _classes(data: bytes) -> np.ndarray:
    return _CLASS[np.frombuffer(data, dtype=np.uint8)]


def class_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text and a newline after it: counts of pairs of neighbouring character classes, and of classes."""
    n, square = len(texts), N_CLASSES**2
    if n == 1 and len(texts[0]) > common.CHUNK:  # a piece at a time, each with the next one's first character
        data, pairs, single = texts[0] + b"\n", np.zeros(square, dtype=np.int64), np.zeros(N_CLASSES, dtype=np.int64)
        for at in range(0, len(data), common.CHUNK):
            c = _classes(data[at : at + common.CHUNK + 1])
            pairs += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=square)
            single += np.bincount(c[: common.CHUNK], minlength=N_CLASSES)
        return pairs[None, :], single[None, :]
    c = _classes(b"\n".join(texts) + b"\n")
    doc = np.repeat(np.arange(n), np.fromiter(map(len, texts), dtype=np.int64, count=n) + 1)
    own = doc[:-1] == doc[1:]
    pairs = np.bincount((doc[:-1] * square + c[:-1] * N_CLASSES + c[1:])[own], minlength=n * square).reshape(n, -1)
    return pairs, np.bincount(doc * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of N_FEATURES for each text; it depends on that text alone."""
    out = np.zeros((len(texts), N_FEATURES))
    for a, b in chunks(texts):
        part = texts[a:b]
        n = len(part)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=n)
        pairs, single = class_counts(part)
        size = np.maximum(lengths, 1)[:, None]
        h, at = words_of(part)
        count = np.diff(at)
        of = np.repeat(np.arange(n, dtype=np.int32), count)
        repeats = [np.bincount(of[k:][(h[k:] == h[:-k]) & (of[k:] == of[:-k])], minlength=n) if len(h) > k else np.zeros(n) for k in (1, 2, 3)]
        words = np.maximum(count, 1)
        out[a:b] = np.hstack((np.sqrt(pairs / size), np.sqrt(single / size), np.stack([np.sqrt(r / words) for r in repeats] + [np.log1p(count), lengths / words, np.sqrt(lengths / words)], axis=1)))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    base: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        raw = _raw(_standard(x, self.mean, self.scale), self.w)
        return 1 / (1 + np.exp(-np.clip(raw - self.cut + np.log(CUT / (1 - CUT)), -500, 500)))


def _standard(x, mean, scale):
    return np.clip((x - mean) / scale, -6, 6)


def _raw(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w, each row summed alike whatever the other rows: scores at the cut itself don't depend on batches."""
    return (z * w).sum(axis=1)


def labelled_features(docs: DataFrame, labels: DataFrame, keep=None) -> DataFrame:
    """(good, x) of all labelled documents, materialised: label over 0, features as bytes; of several rows of one doc_id the text with the least hash."""
    by_id = materialize(labels_by_id(labels, "quality", keep))

    def work(batch):
        return {"doc_id": batch.column(0), "h": batch.column(2), "x": [r.tobytes() for r in features(column_bytes(batch.column(1)))]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).where("doc_id is not null")
    described = lambda df: map_batches(df.select("doc_id", "text", "h"), work, "doc_id long, h long, x binary")
    if by_id.count() <= BROADCAST_ROWS:
        found = described(rows.join(F.broadcast(by_id.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(by_id), "doc_id")
    else:  # features are shuffled, not texts
        found = described(rows).join(by_id, "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("h", "x")).alias("least"))
    out = materialize(one.sortWithinPartitions("doc_id").select((F.col("label") > 0).alias("good"), "least.x"))
    discard(by_id)
    return out


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum of work(x, good), `size` numbers, over slices of rows; summed by task, by groups of tasks, then here, always in one order."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = pa.schema([("part", pa.int64()), ("sums", pa.binary())])
    one = lambda part, sums: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], schema=names)

    def run(batches):
        sums = np.zeros(size)
        for batch in slices(batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(-1, N_FEATURES)
            sums += work(x, np.array(batch.column(0).to_pylist(), dtype=bool))
        yield one(TaskContext.get().partitionId(), sums)

    def again(batches):
        got = sorted((part, x) for batch in batches for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if got:
            yield one(got[0][0], np.sum([np.frombuffer(x) for _, x in got], axis=0))

    parts = rows.mapInArrow(run, "part long, sums binary")
    n = rows.rdd.getNumPartitions()
    if n > 64:
        parts = parts.repartition(int(n**0.5), "part").mapInArrow(again, "part long, sums binary")
    return sum((np.frombuffer(r.sums) for r in sorted(parts.collect())), np.zeros(size))


def _pair_weights(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By label (bad, good) and bin, from counts and sums of raw scores: weights in the gradient and in the curvature; and the mean loss."""
    bad, good = (np.flatnonzero(c) for c in count)
    b, g = total[0, bad] / count[0, bad], total[1, good] / count[1, good]
    n, first, second, loss = count.sum(1).prod(), np.zeros(count.shape), np.zeros(count.shape), 0.0
    for lo in range(0, len(good), 256):
        at = good[lo : lo + 256]
        gap = b[None, :] - g[lo : lo + 256, None]
        p = 1 / (1 + np.exp(-gap))
        first[1, at] = -(p @ count[0, bad]) / n
        first[0, bad] += count[1, at] @ p / n
        second[1, at] = (p * (1 - p)) @ count[0, bad] / n
        second[0, bad] += count[1, at] @ (p * (1 - p)) / n
        loss += count[1, at] @ np.logaddexp(0, gap) @ count[0, bad] / n
    return first, second, float(loss)


def fit_rows(rows: DataFrame, l2: float = 3e-3, rounds: int = 40) -> Model:
    """Newton's method on the mean logistic loss of all pairs of rows (good, x; materialised), with halved steps where the loss would grow."""
    d = N_FEATURES
    moments = _summed(rows, lambda x, good: np.concatenate(([len(x), good.sum()], x.sum(0), (x * x).sum(0))), 2 + 2 * d)
    n, n_good = int(moments[0]), int(moments[1])
    if n_good in (0, n):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, n_good / n if n else 0.5)
    mean = moments[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1e9)
    w, last, bins = np.zeros(d), (np.inf, np.zeros(d)), 2 * BINS + 3
    for _ in range(rounds):
        width = max(BIN, 6 * np.abs(w).sum() / BINS)

        def place(z, w=w, width=width):
            raw = _raw(z, w)
            return raw, np.clip(np.floor(raw / width).astype(np.int64) + BINS + 1, 0, bins - 1)

        def counted(x, good, place=place):
            raw, at = place(_standard(x, mean, scale))
            at = at + bins * good
            return np.concatenate((np.bincount(at, minlength=2 * bins), np.bincount(at, raw, minlength=2 * bins)))

        count, total = _summed(rows, counted, 4 * bins).reshape(2, 2, bins)
        first, second, loss = _pair_weights(count, total)
        loss += l2 / 2 * w @ w
        if loss > last[0] + 1e-7 * abs(last[0]):
            w = (w + last[1]) / 2
            continue
        last = (loss, w)
        # coarse bins hold about the same number of rows each
        coarse = np.minimum(np.cumsum(count.sum(0)) * COARSE / n, COARSE - 1).astype(np.int64)

        middle = total / np.maximum(count, 1)

        def curved(x, good, place=place, first=first, second=second, coarse=coarse, middle=middle):
            z = _standard(x, mean, scale)
            raw, at = place(z)
            label = good.astype(np.int64)
            weight = second[label, at]
            pull = first[label, at] + weight * (raw - middle[label, at])  # second is the slope of first
            sums = (np.arange(2 * COARSE)[:, None] == coarse[at] + COARSE * label).astype(float) @ z
            return np.concatenate((pull @ z, ((z * weight[:, None]).T @ z).ravel(), sums.ravel()))

        got = _summed(rows, curved, d + d * d + 2 * COARSE * d)
        grad, own, sums = got[:d] + l2 * w, got[d : d + d * d].reshape(d, d), got[d + d * d :].reshape(2, COARSE, d)
        of = np.array([np.bincount(coarse, v, minlength=COARSE) for v in (*count, *total)]).reshape(2, 2, COARSE)
        center = of[1] / np.maximum(of[0], 1)
        p = 1 / (1 + np.exp(-(center[0][None, :] - center[1][:, None])))
        cross = sums[1].T @ (p * (1 - p)) @ sums[0] / (n_good * (n - n_good))
        step = np.linalg.solve(own - cross - cross.T + l2 * np.eye(d), grad)
        if np.abs(step).max() < 1e-5:
            break
        w = w - step
    w = last[1]
    model = Model(mean, scale, w, 0.0)
    model.cut = _quantile(rows, model, n, n - n_good)
    return model


def _quantile(rows: DataFrame, model: Model, n: int, n_bad: int) -> float:
    """The quantile of rows' raw scores at n_bad / n, between two neighbouring scores: exact, by ranges of scores until few are left."""
    mean, scale, w = model.mean, model.scale, model.w

    def work(batch):
        return {"raw": _raw(_standard(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float64).reshape(-1, N_FEATURES), mean, scale), w)}

    scored = materialize(map_batches(rows.select("x"), work, "raw double"))
    low, high = (_ranked(scored, n, k) for k in (n_bad - 1, n_bad))
    discard(scored)
    return float(low + (high - low) * (1 - n_bad / n))


def _ranked(scored: DataFrame, n: int, k: int) -> float:
    """The k-th (from 0) of n scores."""
    while n > FEW_SCORES:
        lo, hi = scored.agg(F.min("raw"), F.max("raw")).first()
        if lo == hi:
            return lo
        place = F.least(F.floor((F.col("raw") - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1))
        for r in sorted(scored.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()):  # RANGES rows at most
            if k < r.n:
                break
            k -= r.n
        scored, n = scored.where(place == r.place), r.n
    return float(np.sort(scored.toPandas()["raw"].to_numpy())[k])


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> Model:
    """Fit on all labelled documents (of those in keep, a condition on doc_id)."""
    rows = labelled_features(docs, labels, keep)
    model = fit_rows(rows)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs: one narrow pass."""

    def work(batch):
        s = model.score(features(column_bytes(batch.column(1))))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(crc_of(doc_id) % 5 == 0, F.lit(False))
    return map_batches(docs.select(doc_id.alias("doc_id"), "text", held.alias("held_out")), work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs, with all its columns, of the rows that score `cut` or more: one narrow pass."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(features(column_bytes(batch.column(at)))) >= cut))

    return docs.mapInArrow(run, docs.schema)
