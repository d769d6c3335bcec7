import random

import numpy as np
import pyarrow as pa
import pytest

from txnrules.llm import quality_classifier as Q

SCHEMA = "doc_id long, text string, score string, row int, key string"


def data(n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "re"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        out.append((i, " ".join(word() + (rng.choice(["$$$", "!!", " |"]) if bad else rng.choice(["", "", ","])) for _ in range(rng.randrange(5, 80))), 0 if bad else 1))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t, "", 0, "") for i, t, _ in rows] + [(9001, None, "", 0, ""), (9002, "", "", 0, ""), (None, "a $$$", "", 0, ""), (3, "é " * 30_000, "", 0, "")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (77777, 0)], "doc_id long, quality int")
    vectors = Q.word_vectors(docs)
    return docs, labels, vectors, Q.train(docs, labels.filter(~Q.held_out()), vectors)


def test_held_out_accuracy(spark, learnt):
    docs, labels, vectors, network = learnt
    got = {r.key: r.score for r in Q.score(docs, vectors, network).filter(Q.held_out("key")).collect()}
    truth = {i: y for i, _, y in data()}
    right = [(s >= 0.5) == truth[i] for i, s in got.items() if i in truth]
    assert len(right) > 100 and np.mean(right) > 0.95


def test_every_row_gets_a_score(spark, learnt):
    docs, _, vectors, network = learnt
    got = Q.score(docs, vectors, network)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert got.select("row.*").columns == docs.columns
    assert Q.score(docs.limit(0), vectors, network).count() == 0


def test_word_vectors_match_brute_force(spark):
    texts = ["the cat sat, on", "the cat!", None, ""]
    columns, signs = Q.index_vectors()
    want = np.zeros((1 << Q.SLOT_BITS, Q.DIM))
    for t in texts:
        slots, _ = Q.tokens([(t or "").encode()])
        for i, a in enumerate(slots):
            for j, b in enumerate(slots):
                if 0 < abs(i - j) <= Q.REACH:
                    for c, s in zip(columns[b], signs[b], strict=True):
                        want[a, c] += s
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want, atol=1e-6)


def test_tokens():
    a, doc = Q.tokens([b"The cat,, sat", b"", b"cat"])
    assert doc.tolist() == [0, 0, 0, 0, 2] and a[1] == a[4] and len(set(a.tolist())) == 4


def test_no_labels_of_both_kinds():
    assert Q.Network(np.zeros((0, 64)), np.zeros(0), np.zeros(0, bool)).score(np.zeros((2, 64))).tolist() == [0.5, 0.5]
    assert Q.Network(np.zeros((3, 64)), np.ones(3), np.zeros(3, bool)).score(np.zeros((1, 64))).tolist() == [1.0]
    assert Q.pooled(pa.array([None, ""]), np.ones((1 << Q.SLOT_BITS, Q.DIM), np.float32)).sum() == 0


def test_whole_query_matches_the_definition(spark, tmp_path):
    """Word vectors, documents' vectors, sample and score with dictionaries and loops; the network itself is fitted by the same routine."""
    import random
    import re
    import zlib

    rng = random.Random(88)
    word = lambda good: "".join(rng.choice(["the", "ing", "er"] if good else ["xq", "zz", "kj"]) for _ in range(rng.randrange(1, 4)))
    good = {k: rng.random() < 0.5 for k in range(240)}
    docs = [(k, rng.choice(["", "é ", "a_1! "]) + " ".join(word(good[k] or rng.random() < 0.2) for _ in range(rng.randrange(0, 40)))) for k in good] + [(240, None), (241, ""), (3, "the the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(good[k])) for k in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, signs = Q.index_vectors()

    def slots(text):
        out = []
        for t in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff \t\n\x0b\x0c\r]+", (text or "").encode()):
            h = sum((b + 1) * int(Q.PLACES[i & 255]) for i, b in enumerate(t)) % 2**64
            h ^= h >> 31
            out.append(h * int(Q.SPREAD) % 2**64 >> 64 - Q.SLOT_BITS)
        return out

    sums = {}
    for _, text in docs:
        row = slots(text)
        for i, s in enumerate(row):
            for j in range(max(0, i - Q.REACH), min(len(row), i + Q.REACH + 1)):
                if j != i:
                    for c, sign in zip(columns[row[j]], signs[row[j]], strict=True):
                        sums.setdefault(s, np.zeros(Q.DIM))[c] += sign
    unit = {s: v / max(np.linalg.norm(v), 1e-9) for s, v in sums.items()}

    def features(text):
        v = np.array([unit.get(s, np.zeros(Q.DIM)) for s in slots(text)]).reshape(-1, Q.DIM)
        return np.concatenate([v.mean(axis=0), v.std(axis=0)]) if len(v) else np.zeros(2 * Q.DIM)

    hashes = {r.doc_id: r.h for r in spark.range(242).selectExpr("id AS doc_id", "xxhash64(id) AS h").collect()}
    taught = sorted((hashes[k], good[k], features(t).tolist()) for k, t in docs if k < 200 and zlib.crc32(str(k).encode()) % 3 != 1)
    h = np.array([x[0] for x in taught])
    network = Q.Network(np.array([x[2] for x in taught]), np.array([float(x[1]) for x in taught]), (h // 7) % 5 == 0)
    want = sorted((k, zlib.crc32(str(k).encode()) % 3 == 1, s) for (k, _), s in zip(docs, network.score(np.array([features(t) for _, t in docs])), strict=True))
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in Q.op8_random_indexing(spark, str(tmp_path)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 0.02 and x[3] == (x[2] >= 0.5) for x, y in zip(got, want, strict=True))


def test_pooling_is_the_same_however_many_texts_are_pooled_together(monkeypatch):
    texts = pa.array(["", "a b", None, "one two three " * 50, "x", "é!? ü", " "])
    vectors = np.random.default_rng(5).normal(size=(1 << Q.SLOT_BITS, Q.DIM)).astype(np.float32)
    whole = Q.pooled(texts, vectors)
    monkeypatch.setattr(Q, "AT_ONCE", 2)
    assert np.array_equal(Q.pooled(texts, vectors), whole) and whole[[0, 2, 6]].sum() == 0 and (whole[[1, 3, 4, 5]] != 0).any(axis=1).all()
    slot, doc = Q.tokens([b"ab  " + b"c" * 600, b"", b"ab!"])
    assert doc.tolist() == [0, 0, 2, 2] and slot[0] == slot[2] and len(set(slot.tolist())) == 3
