"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts the next class from the two classes before it: score(w | c1, c2) = (A[c1] + B[c2]) . R[w] + b[w].
The OWN_WORDS most frequent words are a class each. Other words of the head that occur LEAST times or more are
grouped by the company they keep (below); their groups are classes too, as many as the square root of the words that
they hold, so classes and what they hold grow with the corpus up to the bound of the head. All other words, unseen
ones too, are one class. Every partition of the corpus takes NCE steps over all its training tokens from common
parameters; the results are averaged, weighted by tokens, and the next round starts from the average. A word is scored
further by its smoothed share of its class, so every word has a probability and all of them add up to one.

The company of a word is the sum, over all its occurrences in training texts, of fixed random signs of the head words
in the same BLOCK tokens. These sums are whole numbers, the same however the texts are dealt to partitions. Groups are
the clusters of the words' mean company, less the corpus mean.

Because the score is a sum over the two contexts, the normaliser of every context pair comes from one product of two
matrices, exp(A R') times exp(B R' + b)', which each worker makes once; token log-probabilities are then looked up.

Counts of all words come from all training texts, by a shuffle. The HEAD most frequent words (of at most HEAD_BYTES
bytes) travel to the workers; all other words meet their counts in a join, so nothing sent grows with the corpus.

Edge cases: null counts as empty text, which has the end token alone. A word that no training text holds has count 0.
Without training texts N and V are 0 and every token counts as unseen. Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import common

END = b""  # no word is empty
HEAD = 1 << 17
HEAD_BYTES = 64
OWN_WORDS = 1536
LEAST = 2
SIGNS = 16
BLOCK = 16
#: Tokens of a text whose company is added up at a time; a multiple of BLOCK.
PIECE = 1 << 16
DIM = 12
ROUNDS = 1
BATCH = 2048
NOISE = 48
RATE = 0.08
FLUSH = 400_000


def tokens(text: bytes) -> list[bytes]:
    ws = text.lower().split()
    ws.append(END)
    return ws


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column utf8, counted in each partition first."""

    def out(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    def part(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(tokens(t))
                if len(c) > FLUSH:
                    yield out(c)
                    c = Counter()
        if c:
            yield out(c)

    return texts.select("utf8").mapInArrow(part, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[list[bytes], list[int]]:
    """At most `most` of the most frequent words of at most HEAD_BYTES bytes, by count and word, and their counts.

    A histogram over steps of the logarithm of the count gives the smallest count that still fits, so that no task
    sends more than its own part of the head.
    """
    short = counts.filter(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("c") * 64))
    found, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        found += r["count"]
        if found > most:
            break
        least = r["step"]
    rows = short.filter(F.col("step") >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    return [bytes(r["word"]) for r in rows], [r["c"] for r in rows]


def company(texts: DataFrame, words: list[bytes], counts: list[int], total: int) -> np.ndarray:
    """For each word the sum of the signs of the words around it, over all of texts(utf8)."""
    weight = np.maximum(1, np.round(16 * np.sqrt(np.minimum(1, 1e-3 * total / np.array(counts)))))
    signs = np.random.default_rng(5).choice(np.array([-1, 1], np.int8), (len(words), SIGNS)) * weight[:, None].astype(np.int8)
    held = texts.sparkSession.sparkContext.broadcast((words, signs))

    def part(batches):
        own, signs = held.value
        n = len(own)
        ids = {w: i for i, w in enumerate(own)}
        signs = np.concatenate([signs, np.zeros((1, SIGNS), np.int8)]).astype(np.float32)
        found = np.zeros((n, SIGNS))

        def add(pieces):
            lens = np.array([len(p) for p in pieces])
            flat, blocks = np.concatenate(pieces), -(-lens // BLOCK)
            first = np.repeat(np.cumsum(lens) - lens - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())
            own = signs[flat]
            around = np.repeat(np.add.reduceat(own, first), np.diff(np.append(first, len(flat))), axis=0) - own
            for k in range(SIGNS):
                found[:, k] += np.bincount(flat, around[:, k], n + 1)[:n]

        pieces, waiting = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                x = np.array([ids.get(w, n) for w in tokens(t)], np.int64)
                for i in range(0, len(x), PIECE):
                    pieces.append(x[i : i + PIECE])
                    waiting += len(pieces[-1])
                    if waiting >= PIECE:
                        add(pieces)
                        pieces, waiting = [], 0
        if pieces:
            add(pieces)
        some = np.flatnonzero(found.any(1))
        for i in range(0, len(some), 8192):
            at = some[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(found[at, k].astype(np.int64)) for k in range(SIGNS)]], ["id", *names])
        del found, signs, ids
        common.trim()

    names = [f"x{k}" for k in range(SIGNS)]
    sums = texts.select("utf8").mapInArrow(part, "id int, " + ", ".join(f"{c} long" for c in names))
    got = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    held.unpersist()
    out = np.zeros((len(words), SIGNS))
    out[got.column("id").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], 1)
    return out


def groups_of(sums: np.ndarray, counts: list[int]) -> np.ndarray:
    """The group of each word, -1 for those that have a class of their own or are too rare."""
    c = np.array(counts, np.float64)
    out = np.full(len(c), -1)
    at = np.flatnonzero((np.arange(len(c)) >= OWN_WORDS) & (c >= LEAST))
    if not len(at):
        return out
    mean = sums.sum(0) / c.sum()
    x = (sums[at] - c[at, None] * mean) / c[at, None]
    x = (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)
    rng, k = np.random.default_rng(9), math.ceil(math.sqrt(len(at)))
    centers = x[rng.permutation(len(x))[:k]]
    for _ in range(10):
        near = np.concatenate([(x[i : i + 8192] @ centers.T).argmax(1) for i in range(0, len(x), 8192)])
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(size > 0, total / np.maximum(size, 1e-9), centers).astype(np.float32)
    out[at] = near
    return out


class Vocabulary:
    """The head words in order of count, their classes and shares, and the corpus totals."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, groups: np.ndarray | None = None):
        self.words, self.counts = words, np.array(counts, np.float64)
        self.total, self.distinct = total, distinct
        # Classes: the first words (the end token always), groups, then one for all others; one more context for the start.
        n = min(OWN_WORDS, len(words))
        own = np.arange(n)
        if END in words:
            own[-1] = max(own[-1], words.index(END))
        cls = np.full(len(words), -1)
        cls[own] = np.arange(n)
        grouped = np.flatnonzero((cls < 0) & (groups >= 0)) if groups is not None else np.zeros(0, int)
        used = 0
        if len(grouped):
            kinds, at = np.unique(groups[grouped], return_inverse=True)
            cls[grouped], used = n + at, len(kinds)
        self.other = n + used
        self.start = self.other + 1
        inside = cls >= 0
        held = np.bincount(cls[inside], self.counts[inside], self.other)
        size = np.bincount(cls[inside], minlength=self.other)
        self.rest_total = max(0.0, total - held.sum())
        self.rest_distinct = distinct - int(inside.sum())
        self.class_counts = np.append(held, self.rest_total)
        self.classes = {w: k for w, k in zip(words, cls.tolist()) if k >= 0}
        share = self.rest(self.counts)
        share[inside] = np.log10((self.counts[inside] + 0.5) / (held + 0.5 * size)[cls[inside]])
        # The last place is that of words outside of the head.
        self.share = np.append(share, 0.0)
        self.cls = np.append(np.where(inside, cls, self.other), self.other)

    def base(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def rest(self, c):
        return np.log10((c + 0.5) / (self.rest_total + 0.5 * (self.rest_distinct + 1)))


class Model:
    """a, b: vectors of the context one and two places back; r, bias: of the predicted class."""

    NAMES = ("a", "b", "r", "bias")

    def __init__(self, a, b, r, bias):
        self.a, self.b, self.r, self.bias = a, b, r, bias

    @staticmethod
    def new(vocab: Vocabulary, seed: int = 1) -> "Model":
        rng, n = np.random.default_rng(seed), vocab.other + 1
        p = (vocab.class_counts + 0.5) / (vocab.class_counts + 0.5).sum()
        return Model(rng.normal(0, 0.1, (n + 1, DIM)), rng.normal(0, 0.1, (n + 1, DIM)), rng.normal(0, 0.1, (n, DIM)), np.log(p))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.a.ravel(), self.b.ravel(), self.r.ravel(), self.bias])

    def like(self, x: np.ndarray) -> "Model":
        out, i = [], 0
        for y in (self.a, self.b, self.r, self.bias):
            out.append(x[i : i + y.size].reshape(y.shape))
            i += y.size
        return Model(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores from the first and from the second context (with bias), and the log normaliser of every context pair."""
        s1, s2 = (self.a @ self.r.T).astype(np.float32), (self.b @ self.r.T + self.bias).astype(np.float32)
        t1, t2 = s1.max(1, keepdims=True), s2.max(1, keepdims=True)
        return s1, s2, np.log(np.exp(s1 - t1) @ np.exp(s2 - t2).T) + t1 + t2.T


def class_ids(vocab: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens end to end, and of the tokens one and two places back."""
    get, other = vocab.classes.get, vocab.other
    parts = [np.array([get(w, other) for w in tokens(t)], np.int64) for t in texts]
    return contexts(parts, vocab.start)


def contexts(parts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.concatenate(parts)
    lens = np.array([len(p) for p in parts])
    first = np.cumsum(lens) - lens
    c1, c2 = np.roll(w, 1), np.roll(w, 2)
    c1[first] = start
    c2[first] = start
    second = first[lens > 1] + 1
    c2[second] = start
    return w, c1, c2


def _scatter(rows: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    return np.bincount((ids[:, None] * d + np.arange(d)).ravel(), x.ravel(), rows * d).reshape(rows, d)


class Trainer:
    """NCE with Adagrad; one noise sample is shared by a batch."""

    def __init__(self, model: Model, vocab: Vocabulary, seed: int):
        self.m = Model(*[x.copy() for x in (model.a, model.b, model.r, model.bias)])
        self.sums = [np.full(x.shape, 1e-2) for x in (self.m.a, self.m.b, self.m.r, self.m.bias)]
        p = (vocab.class_counts + 0.5) / (vocab.class_counts + 0.5).sum()
        self.noise, self.log_noise = np.cumsum(p), np.log(NOISE * p)
        self.rng, self.seen = np.random.default_rng(seed), 0

    def step(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), len(self.noise) - 1)
        q, rw, rn = m.a[c1] + m.b[c2], m.r[w], m.r[noise]
        up = 1 / (1 + np.exp(np.clip((q * rw).sum(1) + m.bias[w] - self.log_noise[w], -40, 40)))
        down = -1 / (1 + np.exp(np.clip(-(q @ rn.T + m.bias[noise] - self.log_noise[noise]), -40, 40)))
        gq = up[:, None] * rw + down @ rn
        gr = _scatter(len(m.r), w, up[:, None] * q) + _scatter(len(m.r), noise, down.T @ q)
        gb = np.bincount(w, up, len(m.bias)) + np.bincount(noise, down.sum(0), len(m.bias))
        for x, g, s in zip((m.a, m.b, m.r, m.bias), (_scatter(len(m.a), c1, gq), _scatter(len(m.b), c2, gq), gr, gb), self.sums):
            g /= math.sqrt(n)
            s += g * g
            x += RATE * g / np.sqrt(s)
        self.seen += n

    def run(self, w, c1, c2) -> None:
        order = self.rng.permutation(len(w))
        for i in range(0, len(w), BATCH):
            at = order[i : i + BATCH]
            self.step(w[at], c1[at], c2[at])


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of local NCE over every partition of texts(utf8), each followed by a token-weighted average."""
    spark = texts.sparkSession
    model = Model.new(vocab)
    for r in range(rounds):
        held = spark.sparkContext.broadcast((model, vocab))

        def part(batches, r=r, held=held):
            start, words = held.value
            trainer = None
            for b in batches:
                rows = b.column(1).to_pylist()
                if rows and trainer is None:
                    trainer = Trainer(start, words, 1000 * r + b.column(0)[0].as_py() % 1000)
                    task = b.column(0)[0].as_py()
                for i in range(0, len(rows), 1024):
                    trainer.run(*class_ids(words, rows[i : i + 1024]))
            if trainer is not None:
                x = trainer.m.flat().astype(np.float32)
                blocks = np.array_split(x, 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(16), pa.int32()), pa.array([task] * 16, pa.int32()), pa.array([float(trainer.seen)] * 16), pa.array([k.tobytes() for k in blocks], pa.binary())],
                    ["block", "task", "n", "x"],
                )

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf["n"].to_numpy()
            total = np.zeros(len(pdf["x"].iloc[0]) // 4)
            for k, x in zip(n, pdf["x"]):
                total += k * np.frombuffer(x, np.float32)
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1] // 64, "n": [n.sum()], "x": [(total / n.sum()).astype(np.float32).tobytes()]})

        kind = "block int, task int, n double, x binary"
        got = texts.select(F.spark_partition_id().alias("task"), "utf8").mapInArrow(part, kind)
        # Averages of up to 64 tasks, then of those averages, so that no task gathers every partition's parameters.
        got = got.groupBy("block", F.floor(F.col("task") / 64).alias("group")).applyInPandas(lambda pdf: mean(pdf), kind).groupBy("block").applyInPandas(mean, kind)
        parts = {x["block"]: np.frombuffer(x["x"], np.float32) for x in got.collect()}
        if len(parts) == 16:
            model = model.like(np.concatenate([parts[i] for i in range(16)]).astype(np.float64))
        held.unpersist()
    return model


class Scorer:
    """Per text: tokens, known tokens of the head, base and model score so far, and the words outside the head with their counts."""

    def __init__(self, model: Model, vocab: Vocabulary):
        self.vocab = vocab
        self.tables = model.tables()
        self.ids = {w: i for i, w in enumerate(vocab.words)}
        self.base = vocab.base(vocab.counts) if len(vocab.words) else np.zeros(0)
        self.cls, self.rest = vocab.cls, vocab.share
        self.base = np.append(self.base, 0.0)

    def __call__(self, texts: list[bytes]) -> list[list]:
        n, known, base, score, words, counts = [], [], [], [], [], []
        get, missing = self.ids.get, len(self.vocab.words)
        s1, s2, z = self.tables
        for i in range(0, len(texts), 256):
            toks = [tokens(t) for t in texts[i : i + 256]]
            parts = [np.array([get(w, missing) for w in ws], np.int64) for ws in toks]
            flat = np.concatenate(parts)
            w, c1, c2 = contexts([self.cls[p] for p in parts], self.vocab.start)
            log = (s1[c1, w] + s2[c2, w] - z[c1, c2]).astype(np.float64) / math.log(10) + self.rest[flat]
            lens = np.array([len(p) for p in parts])
            first = np.cumsum(lens) - lens
            out = flat == missing
            n += lens.tolist()
            known += (lens - np.add.reduceat(out, first)).tolist()
            base += np.add.reduceat(self.base[flat], first).tolist()
            score += np.add.reduceat(log, first).tolist()
            for ws, p in zip(toks, parts):
                c = Counter([ws[k] for k in np.flatnonzero(p == missing).tolist()])
                words.append(list(c.keys()))
                counts.append(list(c.values()))
        return [n, known, base, score, words, counts]


def score(df: DataFrame, train_rows: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns keep with n_tokens, n_known, train_tokens, base_score and score for each whole text of df."""
    spark = df.sparkSession
    texts = df.filter(train_rows).select(common.utf8(F.col("text")).alias("utf8"))
    counts = common.written(word_counts(texts), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, often = head_of(counts)
    groups = groups_of(company(texts, words, often, total[0]), often) if len(words) > OWN_WORDS else None
    vocab = Vocabulary(words, often, total[0], total[1], groups)
    model = train(texts, vocab)
    held = spark.sparkContext.broadcast((model, vocab))

    def make():
        return Scorer(*held.value)

    fields = "n_tokens long, known long, base double, lm double, words array<binary>, counts array<long>"
    plain = df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("own"), F.monotonically_increasing_id().alias("rid"), F.col("text"))
    rows = common.written(common.map_texts(plain, "text", fields, make, ["own", "rid"]), "scored")
    tail = rows.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    # The end token and short frequent words are in the head; the rest of the counts meet the rest of the tokens.
    tail = tail.join(counts, "word", "left").select("rid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    c = F.col("c").cast("double") + 0.5
    by_rid = tail.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(c / F.lit(vocab.total + 0.5 * (vocab.distinct + 1)))).alias("base_more"),
        F.sum(F.col("n") * F.log10(c / F.lit(vocab.rest_total + 0.5 * (vocab.rest_distinct + 1)))).alias("lm_more"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.drop("words", "counts").join(by_rid, "rid", "left").select(
        "own.*",
        "n_tokens",
        (F.col("known") + zero("more")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("lm") + zero("lm_more")).alias("score"),
    )
