"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - x.w), with one weight vector for all ordered thresholds. Features are markers: a word or
word beginning that occurs at least so often (one of LEVELS) in a text; letters are lowered. Weights are not negative, so
another marker never lowers a text's severity. A text's expected severity is the sum over k >= 1 of P(grade >= k); it is
toxic if P(grade >= 1) is at least CUTOFF.

A marker's evidence is the log likelihood ratio of its share of toxic texts against the sample's. It must exceed the
logarithm of the number of candidates by MARGIN, so that chance passes exp(-MARGIN) of them whatever the sample's size.
Toxic texts count by their distinct contexts (the marker with its neighbours): copies of a passage are one context.

Grades: 0 for a label of 0. A label of 1 is graded 1 to 3 by its lexical severity, the number of markers that hold for it,
cut at the thirds of the toxic texts; the markers that grade one half of the sample are those learned on the other half,
so that a grade never comes from features of its own label.

Null or empty text: scored as a text without features. Null doc_id: kept; not learned from. Repeated rows: one result row
each; the fit takes one text for each doc_id. Very long texts: taken in pieces. No usable labels, labels of one class, or
an empty table: all thresholds stay high, severity 0, nothing is toxic. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, materialize, pieces, slices
from .labelled import labelled_sample

#: Labelled documents that a fit uses at most; all that the driver collects is made of these.
SAMPLE_ROWS = 12_000
#: Characters of a word's beginnings that may become markers, beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Occurrences from which a marker holds.
LEVELS = (1, 2, 4, 8)
#: See above.
MARGIN = 1.0
#: P(grade >= 1) from which a text is toxic.
CUTOFF = 0.5
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def parts(word: str) -> list[str]:
    """The markers that a word may be: itself, and its beginnings, which a star ends."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def words_in(text: bytes) -> Iterator[list[str]]:
    """The words of a text, a piece at a time."""
    for piece in pieces(text):
        yield WORD.findall(piece.decode("utf-8", "replace").lower())


def described(text: bytes) -> dict[str, list[int]]:
    """part -> [occurrences, least hash of its contexts]."""
    out: dict[str, list[int]] = {}
    for words in words_in(text):
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            context = xxhash.xxh3_64_intdigest(f"{before} {word} {after}") >> 1
            for part in parts(word):
                if (mine := out.get(part)) is None:
                    out[part] = [1, context]
                else:
                    mine[0] += 1
                    mine[1] = min(mine[1], context)
    return out


class Stems(dict):
    """word -> numbers of the known parts it has; bounded memory."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.numbers[x] for x in parts(word) if x in self.numbers)
        if len(self) >= 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, text: bytes) -> Counter:
        return Counter(j for words in words_in(text) for found in map(self.__getitem__, words) if found for j in found)


@dataclass
class Model:
    """weights: part -> [(level, weight)]."""

    weights: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 21.0, 22.0)

    def __post_init__(self):
        self.stems = Stems({part: j for j, part in enumerate(self.weights)})
        self.steps = list(self.weights.values())

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.weights, self.thresholds = state
        self.__post_init__()

    def over(self, text: bytes) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        s = math.fsum(w for j, n in self.stems.count(text).items() for level, w in self.steps[j] if n >= level)
        return _sigmoid(s - np.array(self.thresholds))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_features: int, grades: int = 4, l2: float = 1e-4, steps: int = 800, rate: float = 0.05):
    """Sparse (row, column, value) and grades -> weights, ordered thresholds. Projected Adam on the mean log loss with an L2 penalty; w >= 0."""
    n = len(y)
    w, theta0, gaps = np.zeros(n_features), 1.0, np.zeros(grades - 2)
    m, v = np.zeros(n_features + grades - 1), np.zeros(n_features + grades - 1)
    at = np.arange(n)
    for step in range(1, steps + 1):
        s = np.bincount(rows, weights=vals * w[cols], minlength=n) if len(rows) else np.zeros(n)
        theta = theta0 + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        cum = np.hstack((np.zeros((n, 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((n, 1))))
        slope = cum * (1 - cum)
        p = np.maximum(cum[at, y + 1] - cum[at, y], 1e-12)
        ds = (slope[at, y + 1] - slope[at, y]) / p / n  # of the loss by s
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, y + 1, -slope[at, y + 1] / p / n)
        np.add.at(dtheta, y, slope[at, y] / p / n)
        dtheta = dtheta[1:-1]
        dgaps = np.array([dtheta[j + 1 :].sum() * math.exp(gaps[j]) for j in range(grades - 2)])
        g = np.concatenate((np.bincount(cols, weights=vals * ds[rows], minlength=n_features) if len(rows) else np.zeros(n_features), [dtheta.sum()], dgaps))
        g[:n_features] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate * (1 - 0.9 * step / steps)
        move = pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w = np.maximum(w - move[:n_features], 0)
        theta0 -= move[n_features]
        gaps = np.clip(gaps - move[n_features + 1 :], -4, 4)
    return w, tuple(float(x) for x in theta0 + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of toxic texts among those with a marker, against their share in the sample; 0 if not above it."""
    own = toxic / np.maximum(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = toxic * np.log(own / share) + np.where(clean > 0, clean * np.log((1 - own) / (1 - share)), 0.0)
    return np.where(own > share, ratio, 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents."""
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int").alias("half")
    sample = materialize(labelled_sample(docs, labels, "toxic", rows).select("doc_id", "text", (F.col("label") > 0).alias("toxic"), half))
    size = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = ([size.get((t, h), 0) for h in (0, 1)] for t in (True, False))
    if not sum(n_toxic) or not sum(n_clean):
        return Model()

    def occurrences(batch):
        out: dict = {"part": [], "n": [], "context": [], "half": []}
        for text, h in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = described(text)
            out["part"] += found
            out["n"] += [n for n, _ in found.values()]
            out["context"] += [c for _, c in found.values()]
            out["half"] += [h] * len(found)
        return out

    level = F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda x: x <= F.col("n"))).alias("level")
    each = map_batches(sample.where("toxic").select("text", "half"), occurrences, "part string, n int, context long, half int").select("part", "context", "half", level)
    by_context = each.groupBy("part", "level", "context").agg(*(F.count_if(F.col("half") == h).alias(f"t{h}") for h in (0, 1)))
    sums = by_context.groupBy("part", "level").agg(*(e for h in (0, 1) for e in (F.sum(f"t{h}").alias(f"t{h}"), F.count_if(F.col(f"t{h}") > 0).alias(f"x{h}"))), F.count("*").alias("x"))
    candidates = sums.where("x > 1 and t0 + t1 > 1").toArrow()  # numbers and words of the bounded sample, in columns
    if not candidates.num_rows:
        return Model()
    of_part = candidates.column("part").combine_chunks().dictionary_encode()
    names = of_part.dictionary.to_pylist()
    row, step = of_part.indices.to_numpy(), np.searchsorted(LEVELS, candidates.column("level").to_numpy())
    counts = {}
    for name in ("t0", "t1", "x0", "x1", "x"):
        counts[name] = np.zeros((len(names), len(LEVELS)), dtype=np.int64)
        counts[name][row, step] = candidates.column(name).to_numpy()
    numbers = {part: j for j, part in enumerate(names)}
    n_candidates = candidates.num_rows
    del candidates, of_part
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def clean_counts(batch):
        total: Counter = Counter()
        stems = Stems(shared.value)
        for text, h in zip(column_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for j, n in stems.count(text).items():
                total.update((j, i, h) for i, level in enumerate(LEVELS) if level <= n)
        return {"j": [j for j, _, _ in total], "step": [i for _, i, _ in total], "half": [h for *_, h in total], "n": list(total.values())}

    clean = np.zeros((2, len(names), len(LEVELS)), dtype=np.int64)
    found = map_batches(sample.where("not toxic").select("text", "half"), clean_counts, "j int, step int, half int, n long").groupBy("j", "step", "half").agg(F.sum("n").alias("n")).toArrow()
    clean[found.column("half").to_numpy(), found.column("j").to_numpy(), found.column("step").to_numpy()] = found.column("n").to_numpy()
    bar = math.log(n_candidates) + MARGIN
    sides = (
        (np.minimum(counts["t0"], counts["x0"]), clean[0], n_toxic[0], n_clean[0]),
        (np.minimum(counts["t1"], counts["x1"]), clean[1], n_toxic[1], n_clean[1]),
        (np.minimum(counts["t0"] + counts["t1"], counts["x"]), clean[0] + clean[1], sum(n_toxic), sum(n_clean)),
    )
    chosen: list[set] = []  # markers learned on half 0, on half 1, on both
    for toxic, others, t, c in sides:
        over = evidence(toxic, others, t / (t + c)) >= bar if t and c else np.zeros(toxic.shape, dtype=bool)
        chosen.append({(int(j), LEVELS[i]) for j, i in np.argwhere(over)})
    used = {names[j]: j for side in chosen for j, _ in side}

    def features(batch):
        stems = Stems(used)
        found = [stems.count(t) for t in column_bytes(batch.column(0))]
        return {"doc_id": batch.column(1), "toxic": batch.column(2), "half": batch.column(3), "at": [list(c) for c in found], "n": [list(c.values()) for c in found]}

    got = sorted(map_batches(sample.select("text", "doc_id", "toxic", "half"), features, "doc_id long, toxic boolean, half int, at array<int>, n array<int>").collect(), key=lambda r: r.doc_id)
    holds = [{(j, level) for j, n in zip(r.at, r.n, strict=True) for level in LEVELS if level <= n} for r in got]
    severity = np.array([len(h & chosen[1 - r.half]) for r, h in zip(got, holds, strict=True)])
    toxic = np.array([r.toxic for r in got])
    y = np.where(toxic, 1 + np.searchsorted(np.quantile(severity[toxic], [1 / 3, 2 / 3]), severity, side="left"), 0)
    markers = sorted(chosen[2])
    place = {m: i for i, m in enumerate(markers)}
    cells = [(i, place[m]) for i, h in enumerate(holds) for m in sorted(h & chosen[2])]
    line, cols = (np.array([c[k] for c in cells], dtype=np.int64) for k in (0, 1))
    w, thresholds = fit_ordinal(line, cols, np.ones(len(cells)), y, len(markers))
    weights: dict[str, list[tuple[int, float]]] = {}
    for (j, level), x in zip(markers, w, strict=True):
        weights.setdefault(names[j], []).append((level, float(x)))
    return Model(weights, thresholds)


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), toxic for each row of docs: one narrow pass."""

    def work(batch):
        over = [model.over(t) for t in column_bytes(batch.column(1))]
        grade = [int(np.argmax(-np.diff(np.concatenate(([1.0], x, [0.0]))))) for x in over]
        return {"doc_id": batch.column(0), "expected_severity": [float(x.sum()) for x in over], "grade": grade, "toxic": [bool(x[0] >= cutoff) for x in over]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs, with all its columns, without toxic rows: one narrow pass."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(model.over(t)[0] < cutoff) for t in column_bytes(batch.column(at))], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
