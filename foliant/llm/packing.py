"""Packing into sequences of at most CAPACITY tokens by bounded-space online best fit.

Every partition keeps OPEN windows open. A document is cut into pieces of CAPACITY ids and a remainder; full pieces
are sequences of their own, a remainder goes to the open window that it fills best. Where it fits in none, the fullest
window is emitted and a new one takes its place. When a partition ends, its open windows are leftovers; those of
MERGED partitions at a time are merged best-fit, largest first, window by window.

Tokenizing goes word by word: the vocabulary's pre-tokenizer never joins what white space separates, so each distinct
word is encoded once per worker and its ids are looked up after that, up to CACHE words at a time. A text in which the
tokenizer would see one of its special tokens is encoded whole.

Edge cases: null or empty text is its end id alone. Repeated rows are packed separately. Sequence ids are unique but
have gaps. An empty table gives no piece.
"""

from __future__ import annotations

import importlib
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import common

CAPACITY = 4096
OPEN = 64
MERGED = 64
END = 2
CACHE = 600_000
CACHE_LETTERS = 300_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _folded(text: str) -> str:
    """In lower case where all is Latin-1, in which cases map one to one; the vocabulary knows lower case only."""
    return text.lower() if _latin(text) else text


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, the end id last.

    Words are looked up. A new word is taken apart first: the vocabulary's pre-tokenizer gives its letters and the
    signs behind them as two pieces, so letters are encoded once for all their signs and cases. New letters are
    encoded many at a time and parted where a token ends a word; any other word goes through the tokenizer alone.
    """

    SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # Where one of these stands, white space of the tokenizer and of str.split() differ or words don't stand alone.
        self.odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [chr(c) for c in range(28, 32)]
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.end = end.to_bytes(4, "little")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_letters(self, new: list[str]) -> None:
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            if len(cuts) == len(part) + 1 and cuts[-1] == len(data):
                self.letters.update(zip(part, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.letters.update((w, self._whole(w)) for w in part)

    def _learn(self, words: set[str]) -> None:
        if len(self.letters) > CACHE_LETTERS:
            self.letters = {}
        if len(self.signs) > CACHE_LETTERS:
            self.signs = {"": b""}
        parts, new = [], set()
        for w in words:
            stem = w if w.isalpha() else w.rstrip(self.SIGNS)
            # Latin-1 letters are composed, and their cases map one to one without regard to neighbours.
            if stem.isalpha() and (stem.isascii() or _latin(stem)):
                low, sign = stem.lower(), w[len(stem) :]
                parts.append((w, low, sign))
                if low not in self.letters:
                    new.add(low)
                if sign not in self.signs:
                    self.signs[sign] = self._whole(sign)
            else:
                self.known[w] = self._whole(w)
        self._learn_letters(list(new))
        self.known.update((w, self.letters[low] + self.signs[sign]) for w, low, sign in parts)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        plain = [t.decode("utf-8", "replace") for t in texts]
        split = [_folded(t).split() for t in plain]
        known = self.known
        words = set().union(*split)
        new = words.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        self._learn(new)
        get = known.__getitem__
        return [(self._whole(t) if any(s in t for s in self.odd) else b"".join(map(get, ws))) + self.end for t, ws in zip(plain, split)]


def encoder_for(path: str) -> Encoder:
    """One for each Python worker: what a task has looked up serves the next one, until another operator needs the room."""
    if path not in common.WORKER_CACHE:
        common.WORKER_CACHE[path] = Encoder(path)
    return common.WORKER_CACHE[path]


class Packer:
    """Open windows of one partition: place() returns (window, offset); emitted windows are in closed."""

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN):
        self.capacity, self.most = capacity, open_windows
        self.fill: dict[int, int] = {}
        self.next = 0
        self.closed: list[int] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        best, room = -1, self.capacity + 1
        for w, f in self.fill.items():
            r = self.capacity - f - n
            if 0 <= r < room:
                best, room = w, r
                if not r:
                    break
        if best < 0:
            if len(self.fill) >= self.most:
                fullest = max(self.fill, key=lambda w: (self.fill[w], -w))
                del self.fill[fullest]
                self.closed.append(fullest)
            best = self.new()
            self.fill[best] = 0
        at = self.fill[best]
        self.fill[best] = at + n
        if self.fill[best] == self.capacity:
            del self.fill[best]
            self.closed.append(best)
        return best, at


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, open boolean"


def _place(df: DataFrame, path: str | None, capacity: int, open_windows: int) -> DataFrame:
    rows = df.select(F.struct("doc_id").alias("row"), common.utf8(F.col("text")).alias("utf8"), F.spark_partition_id().cast("long").alias("task"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(PIECE).fields])
    names = [f.name for f in schema.fields]

    def part(batches):
        encoder, packer = None, Packer(capacity, open_windows)
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows: their rows wait for the verdict

        def batch(pieces, is_open):
            cols = list(zip(*pieces))
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=row_type), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)], pa.array([is_open] * len(pieces), pa.bool_())], names)

        row_type = None
        for b in batches:
            if not b.num_rows:
                continue
            encoder = encoder or encoder_for(path or tokenizer_path())  # where it lies on this machine
            row_type = b.column(0).type
            own, task = b.column(0).to_pylist(), b.column(2)[0].as_py()
            done = []
            for i in range(0, b.num_rows, 512):
                for row, ids in zip(own[i : i + 512], encoder(b.column(1).slice(i, 512).to_pylist())):
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        data = ids[4 * start : 4 * (start + capacity)]
                        n = len(data) // 4
                        window, at = (packer.new(), 0) if n == capacity else packer.place(n)
                        piece = (row, start, n, zlib.crc32(data), total, task, window, at)
                        if n == capacity:
                            done.append(piece)
                        else:
                            waiting.setdefault(window, []).append(piece)
                            for w in packer.closed:
                                done += waiting.pop(w)
                            packer.closed.clear()
            if done:
                yield batch(done, False)
        left = [p for ps in waiting.values() for p in ps]
        if left:
            yield batch(left, True)

    return rows.mapInArrow(part, schema)


def merge(windows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit, largest first, of whole windows (task, window, n): the (task, window) that each now lies in, and where."""
    w = windows.sort_values(["n", "task", "window"], ascending=[False, True, True]).reset_index(drop=True)
    packer = Packer(capacity, len(w) + 1)
    first: dict[int, int] = {}
    to, at = [], []
    for i, n in enumerate(w["n"].tolist()):
        x, offset = packer.place(n)
        to.append(first.setdefault(x, i))
        at.append(offset)
    return pd.DataFrame({"task": w["task"], "window": w["window"], "to_task": w["task"].to_numpy()[to], "to_window": w["window"].to_numpy()[to], "base": at})


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_windows: int = OPEN, merged: int = MERGED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of df(doc_id, text)."""
    pieces = common.written(_place(df, path, capacity, open_windows), "pieces")
    left = pieces.filter("open").groupBy("task", "window").agg(F.sum("length").alias("n"))
    moved = left.groupBy(F.floor(F.col("task") / merged).alias("group")).applyInPandas(lambda pdf: merge(pdf, capacity), "task long, window long, to_task long, to_window long, base long")
    sequence = lambda task, window: F.shiftleft(task, 40) + window
    done = pieces.filter("not open").select("row.*", "start", "length", "ids_crc32", "doc_tokens", sequence(F.col("task"), F.col("window")).alias("sequence_id"), "offset")
    rest = pieces.filter("open").join(moved, ["task", "window"]).select("row.*", "start", "length", "ids_crc32", "doc_tokens", sequence(F.col("to_task"), F.col("to_window")).alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return done.unionByName(rest)
