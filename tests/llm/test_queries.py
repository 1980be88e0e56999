"""Every query of the ten operators against a brute-force version on a small, odd table, and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import packing, queries

NAMES = [n for n in queries.queries() if n != "pipeline"]


def got(spark, at, name):
    return [r.asDict() for r in queries.queries()[name](spark, at).collect()]


def by_id(found):
    out = defaultdict(list)
    for r in found:
        out[r["doc_id"]].append(r)
    return out


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % mod


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert got(spark, empty_dir, name) == []


def test_language_id(spark, docs_dir, rows):
    found = got(spark, docs_dir, "op1_language_id")
    assert len(found) == len(rows)
    own = by_id(found)
    for doc_id, text, lang, _ in rows:
        for r in own[doc_id]:
            assert r["held_out"] == (crc(doc_id, 4) == 2) and 0 <= r["score"] <= 1
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    held = [(r["lang_pred"], lang) for i, _, lang, _ in rows if lang and i is not None and i < 160 for r in own[i] if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_code_switched_words():
    import random

    from conftest import words
    from foliant.llm import langid

    rng = random.Random(1)
    model = langid.fit([(words(y, 60, rng).encode(), y) for y in ("en", "de") for _ in range(40)])
    tagger = langid.Tagger(model)
    for n, m in ((30, 10), (100, 300), (5, 70)):
        (pred,), (score,) = tagger([(words("en", n, rng) + " " + words("de", m, rng)).encode()])
        assert pred == ("en" if n > m else "de") and abs(score - max(n, m) / (n + m)) < 0.1
    # The blockwise chain gives what plain forward-backward gives.
    e = np.random.default_rng(0).normal(size=(150, 2))
    k = np.exp(model.transitions)
    x = np.exp(e - e.max(1, keepdims=True))
    a = [np.exp(model.initial) * x[0]]
    for t in range(1, len(x)):
        a.append(a[-1] @ k * x[t] / (a[-1] @ k * x[t]).sum())
    b = [np.ones(2)]
    for t in range(len(x) - 1, 0, -1):
        b.append(k @ (x[t] * b[-1]) / (k @ (x[t] * b[-1])).sum())
    p = np.array(a) * np.array(b[::-1])
    want = (p / p.sum(1, keepdims=True)).sum(0)
    assert np.allclose(langid.label_shares(model, e, np.array([150]))[0], want, atol=1e-3)


def test_mixing(spark, docs_dir, rows):
    found = got(spark, docs_dir, "op2_mixing")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{docs_dir}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op2_mixing"]).fetchall()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    mine = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in found), key=key)
    assert mine == sorted(want, key=key)
    total = sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - 1.5 * total) <= 10 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert found and got(spark, docs_dir, "op2_mixing").__len__() == len(rows)


def test_the_queue_decides_what_is_taken(spark):
    """Sizes that don't divide a target: plain fair queueing over packets, which differs from a prefix of each source."""
    from foliant.llm import mixing

    sizes = {"a": [700, 900, 1300, 40], "b": [50, 3000, 60, 80, 2000], "c": [10, 20, 5]}
    docs = [(100 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    line, target = [], {r["source"]: r["target"] for r in got.values()}
    for i, text, s in docs:
        own = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, len(t.split())) for d, t, x in docs if x == s)
        for turn in range(2):
            start = sum(n for *_, n in own) * turn + sum(n for h, d, n in own if (h, d) < (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i))
            n, most = len(text.split()), max(1, int(target[s] // 1000))
            for at in range(0, n, most):
                line.append(((start + min(n, at + most)) / target[s], s, turn, i, min(most, n - at)))
    left, taken = int(1.5 * sum(map(sum, sizes.values()))), Counter()
    for _, _, _, i, n in sorted(line):
        taken[i] += min(n, left)
        left -= min(n, left)
    assert {i: r["taken"] for i, r in got.items()} == {i: taken[i] for i in got}
    for s, t in target.items():
        assert abs(sum(r["taken"] for r in got.values() if r["source"] == s) - t) <= len(target) * max(1, max(target.values()) / 1000) + 1


def test_targets_stop_at_twice_the_size(spark):
    from foliant.llm import mixing

    t = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")).collect()
    target = {r["source"]: r["target"] for r in t}
    assert target["a"] == 20 and target["c"] == 200 and target[None] == 10
    assert math.isclose(sum(target.values()), 1.5 * 1115) and target["b"] < 2000


def dhash(x):
    """Of rows of 64 grey levels, by the exact area under each of 8 by 9 cells, in fractions."""
    from fractions import Fraction

    h, w = len(x), len(x[0])

    def over(n, size, k):  # (pixel, share of it) under cell k of n
        a, b = Fraction(k * size, n), Fraction((k + 1) * size, n)
        return [(p, min(b, p + 1) - max(a, p)) for p in range(int(a), min(size, int(b) + 1)) if min(b, p + 1) > max(a, p)]

    bits = ""
    for i in range(8):
        cells = [sum(fy * fx * x[y][z] for y, fy in over(8, h, i) for z, fx in over(9, w, j)) for j in range(9)]
        bits += "".join(str(int(a < b)) for a, b in zip(cells, cells[1:]))
    return f"{int(bits, 2):016x}"


def test_media(spark, docs_dir, rows):
    own = by_id(got(spark, docs_dir, "op3_media"))
    for doc_id, text, *_ in rows:
        x = (text or "").encode()
        p = x + bytes(-len(x) % 64) if x else bytes(64)
        for r in own[doc_id]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            stored = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            if len(p) < 2000:
                assert r["feature"] == dhash([list(p[k : k + 64]) for k in range(0, len(p), 64)])


def test_line_dedup(spark, docs_dir, rows):
    own = by_id(got(spark, docs_dir, "op4_line_dedup"))
    space = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(space))
    held, top = Counter(), {}
    small = lambda i: -(1 << 63) if i is None else i
    for doc_id, text, *_ in rows:
        for k in {low(x) for x in (text or "").split("\n")}:
            held[k] += 1
            top[k] = max(top.get(k, -(1 << 63)), small(doc_id))
    dropped = 0
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(low(x)) >= 20 and held[low(x)] >= 3 and top[low(x)] != small(doc_id) for x in lines]
        dropped += sum(gone)
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        for r in own[doc_id]:
            assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert dropped > 10


def test_lm_scoring(spark, docs_dir, rows):
    found = got(spark, docs_dir, "op5_lm_scoring")
    own = by_id(found)
    low = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t, *_ in rows if crc(i, 5) != 1 for w in low(t))
    n, v = sum(c.values()), len(c)
    for doc_id, text, *_ in rows:
        want = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in low(text))
        for r in own[doc_id]:
            assert math.isclose(r["base_score"], want, rel_tol=1e-9)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(low(text)), sum(w in c for w in low(text)), n, crc(doc_id, 5) == 1)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_add_up_to_one():
    from foliant.llm import lm

    words = [b"a", b"b", b"c", lm.END]
    vocab = lm.Vocabulary(words, [5, 4, 3, 2], 20, 9)
    s1, s2, z = lm.Model.new(vocab).tables()
    assert np.allclose(np.exp(s1[:, None, :] + s2[None, :, :] - z[:, :, None]).sum(2), 1, atol=1e-4)


def test_lm_groups_share_what_their_class_has(monkeypatch):
    from foliant.llm import lm

    monkeypatch.setattr(lm, "OWN_WORDS", 2)
    words, counts = [b"a", b"b", b"c", b"d", b"e", lm.END, b"f"], [9, 8, 7, 6, 5, 4, 1]
    vocab = lm.Vocabulary(words, counts, 40, 7, np.array([-1, -1, 3, 8, 3, 8, -1]))
    # The end token takes the last class of its own, b goes without a group; 3 and 8 are groups, f and b are the rest.
    assert vocab.cls.tolist() == [0, 4, 2, 3, 2, 1, 4, 4]
    assert vocab.class_counts.tolist() == [9, 4, 12, 6, 9] and vocab.rest_distinct == 2
    share = 10 ** vocab.share
    assert np.allclose([share[:-1][vocab.cls[:-1] == k].sum() for k in range(4)], 1)
    # The last class keeps a place for an unseen word.
    assert np.isclose(share[[1, 6]].sum() + 10 ** vocab.rest(0), 1)


def test_lm_company(spark, docs_dir, rows):
    from foliant.llm import common, lm

    texts = [lm.tokens((t or "").encode()) for _, t, *_ in rows]
    counts = Counter(w for ws in texts for w in ws)
    top = counts.most_common(150)
    words, often = [w for w, _ in top], [c for _, c in top]
    total = sum(counts.values())
    weight = np.maximum(1, np.round(16 * np.sqrt(np.minimum(1, 1e-3 * total / np.array(often)))))
    signs = np.random.default_rng(5).choice(np.array([-1, 1]), (150, lm.SIGNS)) * weight[:, None]
    place = {w: i for i, w in enumerate(words)}
    want = np.zeros((150, lm.SIGNS))
    for ws in texts:
        for i in range(0, len(ws), lm.BLOCK):
            block = [place[w] for w in ws[i : i + lm.BLOCK] if w in place]
            for x in block:
                want[x] += signs[block].sum(0) - signs[x]
    df = common.table(spark, docs_dir, "documents").select(common.utf8(F.col("text")).alias("utf8"))
    for parts in (1, 5):
        assert (lm.company(df.repartition(parts), words, often, total) == want).all()
    assert lm.groups_of(want, often).tolist() == [-1] * 150  # all of them have a class of their own


def test_lm_groups_are_clusters(monkeypatch):
    from foliant.llm import lm

    monkeypatch.setattr(lm, "OWN_WORDS", 4)
    sums = np.array([[0.0, 0.0]] * 4 + [[9.0, 1.0]] * 4 + [[-9.0, -1.0]] * 5)
    found = lm.groups_of(sums * 10, [5] * 12 + [1])
    assert found[:4].tolist() == [-1] * 4 and found[12] == -1  # too rare
    assert len(set(found[4:8])) == len(set(found[8:12])) == 1 and found[4] != found[8]
    assert (lm.groups_of(np.zeros((6, 2)), [3] * 6) >= 0).tolist() == [False] * 4 + [True] * 2


def test_nearest(spark, tmp_path):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(3000, 16)).astype(np.float32)
    vecs[500:1500] = vecs[500]  # one vector many times: ties
    bad = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] + [1.0] * 15), (9080, [1.0] * 3)]
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(vecs)] + [(i, v, 0) for i, v in bad]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = defaultdict(list)
    for r in sorted(got(spark, str(tmp_path), "op6_nearest"), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = vecs.astype(np.float64)
    hit = 0
    assert sorted(found) == list(range(0, 3000, 20))
    for q, near in found.items():
        assert [r for r, *_ in near] == list(range(1, 21))
        for _, v, s in near:
            assert abs(s - (x[q] * x[v]).sum()) < 1e-12 and v != q
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len({v for _, v, _ in near} & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(found)


def test_nearest_where_lists_are_short_and_names_clash(spark, tmp_path):
    """Far apart clusters of less than k vectors, components near the largest of floats, columns named as inside."""
    from foliant.llm import ann

    rng = np.random.default_rng(5)
    v = np.repeat(np.eye(12) * 10, 15, 0) + rng.normal(size=(180, 12)) * 0.01
    v[7] = 1e30
    df = spark.createDataFrame([(i, [float(a) for a in x], "c", 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, list string, score int").withColumn("v", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    for q in range(0, 180, 20):
        assert sorted(r for r, _ in got[q]) == list(range(1, 21))
        s = v @ v[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(180), -s))[:14].tolist())
        assert len(want & {i for _, i in got[q]}) >= 12


@pytest.mark.parametrize(("name", "label", "mod", "rest", "least", "share"), [("op7_quality", lambda t: "|" not in t, 3, 1, 0.5, 0.9), ("op9_toxicity", lambda t: "idiot" in t, 4, 2, 0.3, 0.85)])
def test_classifiers(spark, docs_dir, rows, name, label, mod, rest, least, share):
    found = got(spark, docs_dir, name)
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least) for r in found)
    own = by_id(found)
    held = [(own[i][0]["predicted"], label(t)) for i, t, *_ in rows if i is not None and i < 160 and crc(i, mod) == rest]
    assert all(own[i][0]["held_out"] == (crc(i, mod) == rest) for i, *_ in rows)
    assert sum(a == b for a, b in held) >= share * len(held)


def test_forest_as_plain_trees():
    from foliant.llm import quality

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0.3) | (x[:, 1] * x[:, 2] > 0.5)).astype(float)
    f = quality.fit(x, y)
    new = np.concatenate([rng.normal(size=(100, 6)), x[:20]])
    want = []
    for row in new:
        raw = f.base
        for t in range(len(f.feature)):
            node = 0
            while f.left[t, node] != node:
                node = f.left[t, node] if row[f.feature[t, node]] <= f.threshold[t, node] else f.right[t, node]
            raw += f.value[t, node]
        want.append(1 / (1 + math.exp(-raw)))
    assert np.allclose(f(new), want) and ((f(x) >= 0.5) == y).mean() > 0.95


def test_statistics_of_a_text():
    from foliant.llm import quality

    s = quality.statistics(b"Ab 12, ab\nab ab.")
    assert len(s) == quality.N_CLASSES + 17 and np.isclose(sum(s[: quality.N_CLASSES]), 1)
    n, tail = quality.N_CLASSES, lambda k: s[quality.N_CLASSES + k]
    assert np.isclose(s[0], 7 / 16) and np.isclose(s[1], 1 / 16) and np.isclose(s[2], 2 / 16)  # small and large letters, digits
    assert np.allclose([tail(0), tail(1), tail(2)], np.log1p([16, 5, 2])) and np.isclose(tail(8), 3 / 5) and np.isclose(tail(10), 1 / 5) and np.isclose(tail(12), 1 / 2)
    assert len(quality.statistics(b"")) == n + 17 and not any(quality.statistics(b"")[:n])


def test_toxicity_as_a_plain_window():
    from foliant.llm import toxicity
    from foliant.llm.subword import grams

    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -1.5)
    texts = [b"", b" \n", b"One! two, three", b"a b c d e f g h i j k " * 3, "ßé漢 ... x".encode()]

    def plain(text):
        words = [w for w in (x.strip(toxicity.EDGES) for x in text.decode().lower().split()) if w]
        z = []
        for w in words:
            _, ids = grams([w], toxicity.ORDERS, toxicity.BUCKETS)
            z.append(sum(float(model.z[i]) for i in ids) / len(ids))
        top = max((sum(z[max(0, k - 7) : k + 1]) for k in range(len(z))), default=0.0)
        return 1 / (1 + math.exp(-(model.bias + top / 8)))

    assert np.allclose(toxicity.Scorer(model)(texts), [plain(t) for t in texts], atol=1e-6)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    from foliant.llm import common

    docs = spark.createDataFrame([(i % 40 if i < 400 else None, "x" * (1 + i % 7)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1)], "doc_id long, y int")
    sample = common.labelled_sample(docs, labels, "y", F.lit(True), {0: 1000, 1: 1000})
    assert sample.count() == 40  # one text of each id
    assert sum(len(t) for t in common.fitted(sample, lambda rows: [t for t, _ in rows], 10)) <= 20
    assert common.fitted(sample.limit(0), lambda rows: rows, 10) == []


def test_toxic_words_share_vectors_with_misspellings():
    import random

    from conftest import words
    from foliant.llm import toxicity

    rng = random.Random(3)
    made = []
    for i in range(1600):
        ws = words("en", rng.randint(20, 200), rng).split()
        for _ in range(2 if i % 8 == 0 else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "moron", "worthless", "disgusting"]))
        made.append((" ".join(ws).encode(), int(i % 8 == 0)))
    model = toxicity.fit(made[:1200])
    score = toxicity.Scorer(model)([t for t, _ in made[1200:]])
    y = np.array([y for _, y in made[1200:]])
    assert (score[y == 1] >= 0.3).mean() >= 0.95 and (score[y == 0] >= 0.3).mean() <= 0.02
    bad, fine = model.of_words(["idiiot", "morron", "worthles", "disgustingg"]), model.of_words(["people", "water", "number", "sound"])
    assert bad.min() > fine.max()


def test_packing(spark, docs_dir, rows):
    from tokenizers import Tokenizer

    found = got(spark, docs_dir, "op8_packing")
    t = Tokenizer.from_file(packing.tokenizer_path())
    own = by_id(found)
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        times = sum(r[0] == doc_id for r in rows)
        pieces = sorted(own[doc_id], key=lambda r: r["start"])
        assert Counter(r["start"] for r in pieces) == Counter({s: times for s in range(0, len(ids), 4096)})
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["length"] == min(4096, len(ids) - r["start"]) and r["doc_tokens"] == len(ids)
    seqs = defaultdict(list)
    for r in found:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= sum(r["length"] for r in found) / 4096 * 1.15 + 1


def test_simhash(spark, docs_dir, rows):
    found = by_id(got(spark, docs_dir, "op10_simhash"))
    prints = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    for i, r in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        for f in found[r[0]]:
            assert f["fingerprint"] == f"{prints[i]:016x}" and f["component_id"] == (min(ids) if ids else None)
    assert any(len(g) > 1 for g in groups.values())


def test_links_over_all_near_pairs(spark):
    """Pairs at distance 1 to 3 around a few centres, each found once; chains make one component."""
    from foliant.llm import simhash

    rng = np.random.default_rng(2)
    fps = set()
    for c in rng.integers(-(1 << 63), (1 << 63) - 1, 20).tolist():
        for _ in range(15):
            x = c
            for b in rng.integers(0, 64, 3).tolist():
                x ^= (1 << b) if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want) and want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
