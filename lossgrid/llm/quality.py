"""Quality rules: gradient-boosted trees over document statistics (operator 2).

:func:`statistics` computes counts over each whole text; :func:`fit` boosts
shallow regression trees on the logistic loss of labelled rows, with monotonic
constraints on chosen features, and flattens all trees into numpy node arrays;
:func:`score` walks these arrays for a whole batch at once, one level at a
time.

Fitting uses at most about ``max_rows`` labelled rows (their statistics only),
taken by their id's hash; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import SPACE_BYTES, slices, stage, texts

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and the direction in which quality may go with each
#: (-1: never up, 0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "top_word_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": -1,
    "mark_share": -1,
    "exclaim_share": -1,
    "line_words": 0,
    "longest_word": 0,
}
WINDOW = 5
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Counter5:
    """Counts and features of a text; word hashes are remembered, as words repeat."""

    def __init__(self, remember: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember
        self.factors = np.array([xxhash.xxh3_64_intdigest(f"w{i}".encode()) | 1 for i in range(WINDOW)], np.uint64)

    def repeated(self, hashes: np.ndarray) -> int:
        """Words inside windows of five words that the text holds twice or more."""
        n = len(hashes) - WINDOW + 1
        if n < 2:
            return 0
        keys = hashes[:n] * self.factors[0]
        for i in range(1, WINDOW):
            keys += hashes[i : i + n] * self.factors[i]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(len(hashes) + 1, np.int64)
        steps[:n] += twice
        steps[WINDOW : WINDOW + n] -= twice
        return int((np.cumsum(steps[:-1]) > 0).sum())

    def __call__(self, text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        n = len(words)
        if not n:
            return (0, 0, 0, 0, 0) + (0.0,) * len(FEATURES)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        distinct = set(words)
        for w in distinct.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        chars = len(text) - (len(data) - len(data.translate(None, SPACE_BYTES)))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        dup_lines = len(lines) - len(set(lines))
        repeats = self.repeated(hashes)

        def share(of: bytes) -> float:
            return (len(data) - len(data.translate(None, of))) / max(1, chars)

        top = int(np.unique(hashes, return_counts=True)[1].max())
        features = (
            np.log1p(n),
            chars / n,
            symbols / max(1, chars),
            dup_lines / max(1, len(lines)),
            repeats / n,
            top / n,
            len(distinct) / n,
            share(UPPER),
            share(DIGITS),
            share(MARKS),
            text.count("!") / max(1, chars),
            n / max(1, len(lines)),
            float(max(map(len, distinct))),
        )
        return (n, chars, symbols, dup_lines, repeats) + features


def statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, COUNTS (long) and FEATURES (double) of every row's whole text.

    A null, empty or white-space text has zeros throughout.
    """
    columns = list(keep)
    text = F.col("text").cast("string").alias("_text")
    kept = documents.select(*columns, text)
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter5()
        for batch in slices(batches):
            rows = [counter(t) for t in texts(batch, "_text")]
            found = list(zip(*rows, strict=True))
            arrays = [pa.array(v, pa.int64()) for v in found[: len(COUNTS)]] + [pa.array(v, pa.float64()) for v in found[len(COUNTS) :]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], [*columns, *COUNTS, *FEATURES])

    return kept.mapInArrow(run, types)


@dataclass(frozen=True)
class Forest:
    """All trees in flat node arrays; a leaf's children are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x``: all rows and trees go down a level at a time."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


class _Nodes:
    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self) -> int:
        n = len(self.value)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, n), (self.right, n), (self.value, 0.0)):
            column.append(x)
        return n


def boost(x: np.ndarray, y: np.ndarray, constraints: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Forest:
    """Histogram gradient boosting on the logistic loss.

    A split on a feature with a constraint is taken only if its leaves' values
    follow the direction; their middle then bounds everything below, so the
    whole model is monotonic in that feature.
    """
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]) if len(x) else np.empty((0, x.shape[1]), int)
    nodes, roots, margin = _Nodes(), [], np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + penalty), low, high))

    def grow(node: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        nodes.value[node] = rate * leaf(total_g, total_h, low, high)
        if level == depth or len(rows) < 2:
            out[rows] = nodes.value[node]
            return
        best = (1e-6, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            gs = np.bincount(codes[rows, f], g, len(cut) + 1).cumsum()[:-1]
            hs = np.bincount(codes[rows, f], h, len(cut) + 1).cumsum()[:-1]
            left = np.clip(-gs / (hs + penalty), low, high)
            right = np.clip(-(total_g - gs) / (total_h - hs + penalty), low, high)
            gain = gs**2 / (hs + penalty) + (total_g - gs) ** 2 / (total_h - hs + penalty) - total_g**2 / (total_h + penalty)
            allowed = (hs >= least * 0.05) & (total_h - hs >= least * 0.05) & ((right - left) * constraints[f] >= 0)
            gain = np.where(allowed, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, left[k], right[k]))
        if best[1] is None:
            out[rows] = nodes.value[node]
            return
        f, k, a, b = best[1]
        goes = codes[rows, f] <= k
        one, two = nodes.add(), nodes.add()
        nodes.feature[node], nodes.threshold[node], nodes.left[node], nodes.right[node] = f, cuts[f][k], one, two
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(constraints[f])]
        grow(one, rows[goes], level + 1, *bounds[0])
        grow(two, rows[~goes], level + 1, *bounds[1])

    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian, out = p - y, p * (1 - p), np.zeros(len(y))
        root = nodes.add()
        roots.append(root)
        grow(root, np.arange(len(y)), 0, -np.inf, np.inf)
        margin = margin + out
    if not roots:
        roots.append(nodes.add())
    return Forest(np.array(nodes.feature), np.array(nodes.threshold), np.array(nodes.left), np.array(nodes.right), np.array(nodes.value), np.array(roots), depth, base)


def fit(stats: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **settings) -> Forest:
    """Trees from the statistics (doc_id, FEATURES) of labelled rows (doc_id, quality).

    An id with several labels counts as good only if all say so; null labels
    are not used.  With labels of one kind only, every score is that kind's.
    """
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("label_id is not null and quality is not null")
    marked = marked.groupBy("label_id").agg(F.min("quality").alias("quality"))
    total = marked.count()
    part = int((1 << 30) * min(1.0, max_rows / max(1, total)))
    marked = marked.where(F.pmod(F.xxhash64(F.col("label_id").cast("long"), F.lit(2)), F.lit(1 << 30)) < part)
    rows = stats.join(marked, F.col("doc_id") == F.col("label_id")).select(*FEATURES, "quality").toPandas()
    rows = rows.sort_values([*FEATURES, "quality"])  # the order of rows must not matter
    return boost(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), np.array(list(FEATURES.values())), **settings)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add ``quality`` (probability of a good document) to every row of statistics."""
    names = list(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.probability(x))], [*batch.schema.names, "quality"])

    kept = stats.drop("quality")
    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias("quality")).schema)


def assess(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, COUNTS, FEATURES and quality of every row of ``documents`` (doc_id, text)."""
    stats = stage(statistics(documents), "statistics")
    return score(stats, fit(stats, labels, **settings))
