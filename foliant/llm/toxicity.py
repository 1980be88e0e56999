"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of its whole form, so an unseen
misspelling shares vectors with the word it distorts. A bag is a window of WINDOW consecutive words, averaged over
WINDOW places (missing places count as zero); the softmax layer reads that average. A text scores as its most toxic
window, which keeps one insult in a long text from being averaged away; training sees texts in the same way: the
gradient of a text flows through the window that scores highest. Training starts from the n-grams that tell toxic
texts apart beyond chance, so that the first windows are the right ones also where toxic texts are few.

The fit runs in one task over a bounded sample; only the model comes to the driver.

Edge cases: null or empty text, or text without words, scores as the empty bag. Without training labels, or with one
class only, the score is that class's share (0.0 where there are no labels). Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.llm.subword import grams

WINDOW = 8
ORDERS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 45
#: N-grams of fewer training texts have no vector of their own.
LEAST_TEXTS = 2
#: Weight of a fixed prior on the logits of n-grams, over the number of training texts.
PRIOR = 1.4e-3
LEAST_SHARE = 0.25
#: Share of the log odds that n-grams which tell toxic texts apart start with.
START = 1.0
#: Bounds of the labelled sample that the classifier is fitted on: rows and bytes of text of each label.
SAMPLE = {0: 3000, 1: 1500}
SAMPLE_BYTES = 10 << 20
CACHE = 100_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”’‘…–—"


def words_of(text: bytes) -> list[str]:
    return [w for w in [x.strip(EDGES) for x in text.decode("utf-8", "replace").lower().split()] if w]


class Model:
    """z: the toxic-minus-clean logit of each bucket (embedding times softmax weights); bias: of an empty bag."""

    def __init__(self, z: np.ndarray, bias: float, constant: float | None = None):
        self.z, self.bias, self.constant = z, bias, constant

    def of_words(self, words: list[str]) -> np.ndarray:
        owner, ids = grams(words, ORDERS, len(self.z))
        n = len(words)
        return np.bincount(owner, self.z[ids], n) / np.maximum(np.bincount(owner, minlength=n), 1)


def _windows(z: np.ndarray) -> np.ndarray:
    """Sums over the WINDOW places that end at each word."""
    c = np.concatenate([[0.0], np.cumsum(z, dtype=np.float64)])
    i = np.arange(1, len(c))
    return c[i] - c[np.maximum(i - WINDOW, 0)]


def _vocabulary_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of all n-grams in order of owner, and one over each word's number of them; made in parts."""
    owners, ids, share = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.empty(len(words), np.float32)
    for i in range(0, len(words), 8192):
        part = words[i : i + 8192]
        o, x = grams(part, ORDERS, BUCKETS)
        order = np.argsort(o, kind="stable")
        share[i : i + len(part)] = 1.0 / np.bincount(o, minlength=len(part))
        owners.append((o[order] + i).astype(np.int32))
        ids.append(x[order].astype(np.int32))
    return np.concatenate(owners), np.concatenate(ids), share


def _tops(word: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's largest window sum and the words of that window; texts are taken in groups of bounded size."""
    top, inside = np.empty(len(docs), np.float32), []
    i = 0
    while i < len(docs):
        j, n = i, 0
        while j < len(docs) and (j == i or n + len(docs[j]) <= 1 << 17):
            n += len(docs[j])
            j += 1
        flat = np.concatenate(docs[i:j])
        ends = np.cumsum([len(d) for d in docs[i:j]])
        starts = ends - [len(d) for d in docs[i:j]]
        first = np.maximum(np.arange(len(flat)) - WINDOW + 1, np.repeat(starts, ends - starts))
        c = np.concatenate([[0.0], np.cumsum(word[flat], dtype=np.float64)])
        s = c[1:] - c[first]
        top[i:j] = np.maximum.reduceat(s, starts)
        for a, b in zip(starts.tolist(), ends.tolist()):
            at = a + int(np.argmax(s[a:b]))
            inside.append(flat[first[at] : at + 1])
        i = j
    return top, inside


def _summed(to: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[at] by to, in blocks, so that little is held besides."""
    out = np.zeros(n)
    for i in range(0, len(to), 1 << 19):
        out += np.bincount(to[i : i + (1 << 19)], values[at[i : i + (1 << 19)]], n)
    return out.astype(np.float32)


def _telling(texts_of: np.ndarray, toxic_of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where training starts: the log odds of n-grams found in so many more toxic texts than chance gives that not one such
    n-gram is expected by chance, zero for all others. With few toxic texts this is what shows the first windows."""
    share = y.mean()
    d, k = np.maximum(texts_of, 1).astype(np.float64), toxic_of.astype(np.float64)
    q = np.clip(k / d, 1e-9, 1 - 1e-9)
    surprise = np.where(q > share, d * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))), 0.0)  # a bound of the binomial tail
    odds = np.log((k + 0.5) / (y.sum() + 1)) - np.log((d - k + 0.5) / (len(y) - y.sum() + 1))
    return np.where(surprise > np.log(max(2, (texts_of >= LEAST_TEXTS).sum())), START * odds, 0.0)


def fit(rows: list[tuple[bytes, int]], seed: int = 5) -> Model:
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(2), 0.0, float(y.mean()) if len(y) else 0.0)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t, _ in rows]
    n_words = len(vocab)
    owner, ids, share = _vocabulary_grams(list(vocab))
    del vocab
    # An n-gram of fewer texts than that can only memorise them; it has no vector, and its places are left out below.
    first_of = np.searchsorted(owner, np.arange(n_words + 1))
    texts_of, toxic_of = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for d, label in zip(docs, y):
        ws = np.unique(d)
        n = first_of[ws + 1] - first_of[ws]
        at = np.repeat(first_of[ws] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        texts_of[np.unique(ids[at])] += 1
        toxic_of[np.unique(ids[at])] += int(label)
    common_enough = (texts_of >= LEAST_TEXTS).astype(np.float32)
    keep = common_enough[ids] > 0
    owner, ids = owner[keep], ids[keep]
    first = _telling(texts_of, toxic_of, y)
    full = [i for i, d in enumerate(docs) if len(d)]
    docs, target = [docs[i] for i in full], y[full]
    # Toxic texts are rare; they count as at least LEAST_SHARE of the clean ones.
    weight = np.where(target == 1, max(1.0, LEAST_SHARE * (target == 0).sum() / max(1, target.sum())), 1.0)
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    u = rng.normal(0, 1.0, (DIM, 2)).astype(np.float32)
    du = u[:, 1] - u[:, 0]
    e = (rng.normal(0, 0.05, (BUCKETS, DIM)) * common_enough[:, None] + np.outer(first, du / (du @ du))).astype(np.float32)
    b = np.array([0.0, -2.0], np.float32)
    params, m, v = [e, u, b], [np.zeros_like(x) for x in (e, u, b)], [np.zeros_like(x) for x in (e, u, b)]
    for t in range(1, EPOCHS + 1):
        du = u[:, 1] - u[:, 0]
        z = e @ du
        word = _summed(owner, z, ids, n_words) * share
        top, inside = _tops(word, docs)
        p = 1 / (1 + np.exp(-np.clip(b[1] - b[0] + top / WINDOW, -50, 50)))
        g = weight * (p - target) / len(target)
        gw = np.bincount(np.concatenate(inside), np.repeat(g / WINDOW, [len(x) for x in inside]), n_words).astype(np.float32) * share
        gz = _summed(ids, gw, owner, BUCKETS) * common_enough + np.float32(PRIOR / len(target)) * z
        gu = e.T @ gz + 1e-4 * du
        grads = [np.outer(gz, du), np.stack([-gu, gu], 1), np.array([-g.sum(), g.sum()], np.float32)]
        for k, (x, dx) in enumerate(zip(params, grads)):
            m[k] *= 0.9
            m[k] += 0.1 * dx
            v[k] *= 0.99
            v[k] += 0.01 * dx * dx
            x -= (0.05 / (1 - 0.9**t)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Model((e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(b[1] - b[0]))


class Scorer:
    """Scores texts of a partition; words already seen are looked up, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        model, out = self.model, np.empty(len(texts))
        if model.constant is not None:
            out[:] = model.constant
            return out
        for i in range(0, len(texts), 64):
            part = [words_of(t) for t in texts[i : i + 64]]
            new = list({w for ws in part for w in ws if w not in self.known})
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, list({w for ws in part for w in ws})
            self.known.update(zip(new, model.of_words(new).tolist()))
            get = self.known.__getitem__
            for j, ws in enumerate(part):
                top = _windows(np.fromiter(map(get, ws), np.float64, len(ws))).max() if ws else 0.0
                out[i + j] = 1 / (1 + np.exp(-np.clip(model.bias + top / WINDOW, -50, 50)))
        return out


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, train_rows=None) -> Model:
    keep = F.lit(True) if train_rows is None else train_rows
    return common.fitted(common.labelled_sample(documents, labels, "toxic", keep, SAMPLE), fit, SAMPLE_BYTES)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all where None), as they are, with the toxicity of each whole text in column out."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)
        return lambda texts: [scorer(texts)]

    return common.map_texts(df, text, f"{out} double", make, keep)
