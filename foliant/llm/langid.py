"""Language ID: a linear-chain conditional random field labels every word, also in code-switched text.

Features of a word are its hashed character n-grams with word ends marked (so its affixes) and its whole form (the
learned lexicon); transitions between labels are learned. Training texts carry one language each, so training
sequences are cut from them: half of one language, half of spans of several languages laid end to end, each word
labelled with the language of its text. Prediction runs forward-backward over the whole text and adds up the label
probabilities of its words.

The chain is evaluated for many texts at once: words are cut into segments of SEGMENT words, every segment's
transfer matrix is built in parallel, the matrices are chained segment by segment, and messages then flow inside all
segments in parallel. This is exact; no window is cut off.

Edge cases: null or empty text, or text without a letter, gives `und` with score 0. A learned language never is null.
Without training rows every text is `und`. Repeated rows get equal results. Long texts are processed whole, in
blocks of at most BLOCK words where texts are short, one text at least.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.llm.subword import grams

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Bounds of the sample of training texts of each language: rows, bytes of text. Texts are read whole.
SAMPLE = 160
SAMPLE_BYTES = 1 << 19
LENGTH = 40
EPOCHS = 30
SEGMENT = 64
BLOCK = 400_000
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, initial: np.ndarray):
        self.labels, self.weights, self.transitions, self.initial = labels, weights, transitions, initial

    def emissions(self, words: list[str]) -> np.ndarray:
        owner, ids = grams(words, ORDERS, self.weights.shape[0])
        n = np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1))
        return np.stack([np.bincount(owner, w[ids], len(words)) / n for w in self.weights.T], 1)


def _sequences(texts: list[tuple[np.ndarray, int]], rng) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels) of sequences of LENGTH places, -1 where there is no word: every word of the texts once."""
    pure, spans = [], []
    for ws, y in texts:
        for i in range(0, len(ws), 2 * LENGTH):
            pure.append((ws[i : i + LENGTH], y))
            rest = ws[i + LENGTH : i + 2 * LENGTH]
            while len(rest):
                n = int(rng.integers(3, 16))
                spans.append((rest[:n], y))
                rest = rest[n:]
    order = [spans[k] for k in rng.permutation(len(spans))]
    mixed = np.concatenate([x for x, _ in order]) if order else np.zeros(0, np.int32)
    labels = np.repeat(np.array([y for _, y in order], np.int32), [len(x) for x, _ in order])
    n = len(pure) + -(-len(mixed) // LENGTH)
    word, gold = np.full((n, LENGTH), -1, np.int32), np.zeros((n, LENGTH), np.int32)
    for k, (ws, y) in enumerate(pure):
        word[k, : len(ws)], gold[k] = ws, y
    word[len(pure) :].reshape(-1)[: len(mixed)] = mixed
    gold[len(pure) :].reshape(-1)[: len(mixed)] = labels
    return word, gold


def fit(rows: list[tuple[bytes, str]], seed: int = 3) -> Model | None:
    labels = sorted({y for _, y in rows})
    vocab: dict[str, int] = {}
    texts = [(np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32), labels.index(y)) for t, y in rows]
    rng = np.random.default_rng(seed)
    word, gold = _sequences(texts, rng)
    if not len(word):
        return None
    n, k = len(word), len(labels)
    word, gold = np.ascontiguousarray(word.T), np.ascontiguousarray(gold.T)  # places of all sequences lie together
    real = word >= 0
    owner, ids = grams(list(vocab), ORDERS, BUCKETS)
    owner, ids = owner.astype(np.int32), ids.astype(np.int32)
    scale = 1.0 / np.sqrt(np.bincount(owner, minlength=len(vocab)))
    w, tr, init = np.zeros((k, BUCKETS)), np.zeros((k, k)), np.zeros(k)
    flat, want = word[real], gold[real]
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (gold[:-1][real[1:]], gold[1:][real[1:]]), 1)
    gold_i = np.bincount(gold[0], minlength=k)
    m, v = [0.0] * 3, [0.0] * 3
    short = [not r.all() for r in real]
    for t in range(1, EPOCHS + 1):
        e = np.stack([np.bincount(owner, w[j][ids], len(vocab)) for j in range(k)], 1) * scale[:, None]
        e = np.exp(e - e.max(1, keepdims=True))
        x = np.ones((LENGTH, n, k))
        x[real] = e[flat]
        step = np.exp(tr)
        a, bt = np.empty((LENGTH, n, k)), np.empty((LENGTH, n, k))
        a[0] = np.exp(init) * x[0]
        a[0] /= a[0].sum(1, keepdims=True)
        for i in range(1, LENGTH):
            q = (a[i - 1] @ step) * x[i]
            q /= q.sum(1, keepdims=True)
            a[i] = np.where(real[i, :, None], q, a[i - 1]) if short[i] else q
        bt[-1] = 1.0
        pair = np.zeros((k, k))
        for i in range(LENGTH - 1, 0, -1):
            f = x[i] * bt[i]
            q = f @ step.T
            # Shares of label pairs, summed over the sequences that have a word here.
            pair += step * (a[i - 1].T @ (f * (real[i] / (a[i - 1] * q).sum(1))[:, None]))
            q /= q.sum(1, keepdims=True)
            bt[i - 1] = np.where(real[i, :, None], q, bt[i]) if short[i] else q
        p = a * bt
        p /= p.sum(2, keepdims=True)
        first = p[0].sum(0)
        diff = p[real]
        diff[np.arange(len(want)), want] -= 1
        gv = np.stack([np.bincount(flat, diff[:, j], len(vocab)) for j in range(k)]) * scale
        gw = np.stack([np.bincount(ids, g[owner], BUCKETS) for g in gv]) / n + 1e-5 * w
        grads = [gw, (pair - gold_t) / n + 1e-4 * tr, (first - gold_i) / n]
        for j, (par, g) in enumerate(zip((w, tr, init), grads)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            par -= 0.1 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    w = w.T
    return Model(labels, w.astype(np.float32), tr, init)


def label_shares(model: Model, emissions: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Expected number of words of each label in each sequence; emissions of all words end to end, lens of sequences (over 0)."""
    k, s = emissions.shape[1], SEGMENT
    step = np.exp(model.transitions).astype(np.float32)
    x = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)
    segs = -(-lens // s)
    first = np.cumsum(segs) - segs
    total = int(segs.sum())
    seg_of = np.repeat(np.arange(len(lens)), segs)
    rank = np.arange(total) - first[seg_of]
    start = (np.cumsum(lens) - lens)[seg_of] + rank * s
    size = np.minimum(s, lens[seg_of] - rank * s)
    order = np.argsort(-size, kind="stable")  # segments that still have words at a place form a prefix
    start, size = start[order], size[order]
    live = [int(np.searchsorted(-size, -i, side="left")) for i in range(s)]  # segments with size > i
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    # The first word of a text has no transition before it; the initial weights take its place.
    head = rank[order] == 0
    mat = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    for i in range(s):
        n = live[i]
        if not n:
            break
        q = (mat[:n].reshape(-1, k) @ step).reshape(n, k, k)
        if i == 0:
            q[head[:n]] = mat[:n][head[:n]]
        q *= x[start[:n] + i][:, None, :]
        mat[:n] = q / q.sum((1, 2), keepdims=True)
    into = np.empty((total, k), np.float32)  # forward message before a segment
    after = np.empty((total, k), np.float32)  # backward message behind it
    first_in = np.exp(model.initial - model.initial.max()).astype(np.float32)
    deep = int(segs.max())
    by_len = np.argsort(-segs, kind="stable")
    counts = np.searchsorted(-segs[by_len], -np.arange(deep), side="left")
    msg = np.broadcast_to(first_in, (len(lens), k)).copy()
    for r in range(deep):
        d = by_len[: counts[r]]
        at = back[first[d] + r]
        into[at] = msg[d]
        q = np.einsum("ni,nij->nj", msg[d], mat[at])
        msg[d] = q / q.sum(1, keepdims=True)
    msg = np.ones((len(lens), k), np.float32)
    for r in range(deep - 1, -1, -1):
        d = by_len[: counts[r]]
        at = back[first[d] + r]
        after[at] = msg[d]
        q = np.einsum("nij,nj->ni", mat[at], msg[d])
        msg[d] = q / q.sum(1, keepdims=True)
    a = np.empty((s, total, k), np.float32)
    cur = into
    for i in range(s):
        n = live[i]
        if not n:
            break
        q = cur[:n] @ step
        if i == 0:
            q[head[:n]] = cur[:n][head[:n]]
        q = q * x[start[:n] + i]
        a[i, :n] = q / q.sum(1, keepdims=True)
        cur = a[i]
    out = np.zeros((total, k))
    b = after.copy()
    for i in range(s - 1, -1, -1):
        n = live[i]
        if not n:
            continue
        p = a[i, :n] * b[:n]
        out[:n] += p / p.sum(1, keepdims=True)
        if i:
            q = (x[start[:n] + i] * b[:n]) @ step.T
            b[:n] = q / q.sum(1, keepdims=True)
    shares = np.zeros((len(lens), k))
    np.add.at(shares, seg_of, out[back])
    return shares


class Tagger:
    def __init__(self, model: Model | None):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.labels) if model else 0))

    def _learn(self, part: list[list[str]]) -> None:
        new = list({w for ws in part for w in ws if w not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known, self.table = {}, self.table[:0]
            new = list({w for ws in part for w in ws})
        if new:
            base = len(self.table)
            self.table = np.concatenate([self.table, self.model.emissions(new)])
            # A token of number letters only (such as Roman numeral signs) holds no letter.
            self.known.update((w, base + i if any(map(str.isalpha, w)) else -1) for i, w in enumerate(new))

    def __call__(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if self.model is None:
            return pred, score
        i = 0
        while i < len(texts):
            part, n, j = [], 0, i
            while j < len(texts) and (n < BLOCK or j == i) and j - i < 1024:
                part.append(words_of(texts[j]))
                n += len(part[-1])
                j += 1
            self._learn(part)
            get = self.known.__getitem__
            ids = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in part]
            ids = [x[x >= 0] for x in ids]
            some = [d for d, x in enumerate(ids) if len(x)]
            if some:
                lens = np.array([len(ids[d]) for d in some])
                got = label_shares(self.model, self.table[np.concatenate([ids[d] for d in some])], lens)
                best = got.argmax(1)
                for d, y, p in zip(some, best, got[np.arange(len(some)), best] / got.sum(1)):
                    pred[i + d], score[i + d] = self.model.labels[y], float(min(1.0, p))
            i = j
        return pred, score


def train(documents: DataFrame, train_rows) -> Model | None:
    """Fits on about SAMPLE texts of each non-null language among the rows that train_rows keeps. The model holds BUCKETS
    weights for each of them."""
    rows = documents.filter(train_rows & F.col("lang").isNotNull()).select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text")
    return common.fitted(common.one_of_each(common.stratified(rows, "label", "key", SAMPLE), "key", "label", "text"), fit, SAMPLE_BYTES)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all where None) with lang_pred and score for each whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return Tagger(held.value)

    return common.map_texts(df, text, "lang_pred string, score double", make, keep)
