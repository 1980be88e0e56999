"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes, words and lines of the whole text. Trees grow on binned statistics with second-order
gains; the fitted forest is flattened into arrays (feature, threshold, children, value) and scored by moving all rows
of a batch through all trees one level at a time in numpy.

Edge cases: null counts as empty text, whose statistics are zeros; it is scored like any other. Without training
labels the score is 0.5; with one class only it is that class. Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from foliant.llm import common

BINS = 48
TREES = 70
DEPTH = 5
RATE = 0.12
LEAST = 20
#: Bounds of the labelled sample that the classifier is fitted on: rows and bytes of text of each label.
SAMPLE = {0: 3000, 1: 4000}
SAMPLE_BYTES = 16 << 20

_CLASSES = np.zeros(256, np.int64)
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b";:!?", b"'\"`", b"()[]{}<>", b"|", b"/\\", b"-_~", b"#$%&*+=@^"]
for _i, _g in enumerate(_GROUPS):
    _CLASSES[list(_g)] = _i
_CLASSES[128:] = len(_GROUPS)
_CLASSES[[c for c in range(32) if c not in b"\n\t\r\x0b\x0c"] + [127]] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
_ONE_HOT = np.eye(N_CLASSES)[_CLASSES]


def statistics(text: bytes) -> list[float]:
    n = max(len(text), 1)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT / n).tolist()
    words = text.lower().split()
    lines = text.split(b"\n")
    w, k = max(len(words), 1), max(len(lines), 1)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    same = sum(map(bytes.__eq__, words[1:], words))
    ends = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines)
    return shares + [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lens.mean(), lens.std(), lens.max(), (lens <= 3).sum() / w, (lens >= 10).sum() / w,
        len(set(words)) / w, len(set(words)) / np.sqrt(w), same / w, len(set(lines)) / k, ends / k, n / k, sum(not x.isalpha() for x in words) / w,
        sum(x.isdigit() for x in words) / w, sum(len(x) == 1 for x in words) / w,
    ]


class Forest:
    """Flattened trees: in row t and node i, the feature tested, its threshold, the child taken at most it and the other, the value."""

    def __init__(self, feature, threshold, left, right, value, base, depth):
        self.feature, self.threshold, self.left, self.right, self.value, self.base, self.depth = feature, threshold, left, right, value, base, depth

    def __call__(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(go, self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[trees, at].sum(1), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    one = np.zeros((1, 1), np.int64)
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (50.0 if y[0] else -50.0)
        return Forest(one, np.zeros((1, 1)), one, one, np.zeros((1, 1)), base, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)  # bin b: v <= cuts[b]
    d = x.shape[1]
    flat = binned + np.arange(d) * BINS
    p0 = y.mean()
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(len(y), base)
    size = 2 ** (DEPTH + 1) - 1
    feature, left, right = (np.zeros((TREES, size), np.int64) for _ in range(3))
    threshold, value = np.full((TREES, size), np.inf), np.zeros((TREES, size))
    left[:], right[:] = np.arange(size), np.arange(size)  # a leaf leads to itself
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        todo, used = [(0, np.arange(len(y)), 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[t, node] = RATE * gs / (hs + 1.0)
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                f = flat[rows].ravel()
                gh = np.bincount(f, np.repeat(g[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                hh = np.bincount(f, np.repeat(h[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                nn = np.bincount(f, minlength=d * BINS).reshape(d, BINS).cumsum(1)
                gain = gh**2 / (hh + 1.0) + (gs - gh) ** 2 / (hs - hh + 1.0) - gs**2 / (hs + 1.0)
                gain[(nn < LEAST) | (len(rows) - nn < LEAST)] = -1
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, node], threshold[t, node] = j, cuts[j][b]
                    left[t, node], right[t, node] = used, used + 1
                    go = binned[rows, j] <= b
                    todo += [(used, rows[go], depth + 1), (used + 1, rows[~go], depth + 1)]
                    used += 2
                    continue
            raw[rows] += value[t, node]
    inner = left != np.arange(size)
    value[inner] = 0.0
    return Forest(feature, threshold, left, right, value, base, DEPTH)


def fit_texts(rows: list[tuple[bytes, int]]) -> Forest:
    return fit(np.array([statistics(t) for t, _ in rows]), np.array([y for _, y in rows], np.float64))


def train(documents: DataFrame, labels: DataFrame, train_rows) -> Forest:
    return common.fitted(common.labelled_sample(documents, labels, "quality", train_rows, SAMPLE), fit_texts, SAMPLE_BYTES)


def score(df: DataFrame, model: Forest, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all where None) with the quality of each whole text in column out."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def texts_to_scores(texts):
            found = []
            for i in range(0, len(texts), 2048):
                found.append(held.value(np.array([statistics(t) for t in texts[i : i + 2048]])))
            return [np.concatenate(found)]

        return texts_to_scores

    return common.map_texts(df, text, f"{out} double", make, keep)
