import random
import re

import numpy as np

from txnrules.llm import groups
from txnrules.llm import jaccard_join as J
from txnrules.llm import shingles as S

SCHEMA = "doc_id long, text string, node long, root string, class_id int"


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def data():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "ünd"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = make(rng.randrange(30, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(", ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += ["two words", "Two WORDS!", "two other", None, None, "", " .,", " ".join(make(20_000))]
    return list(enumerate(texts)) + [(None, texts[0]), (0, texts[0]), (3, "another text with the same id as one before")]


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    link = [[bool(a and b) and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    root = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(link):
            root[i] = min([root[i], *(root[j] for j, y in enumerate(x) if y)])
    return [sum(x) - bool(s) for x, s in zip(link, sets, strict=True)], root


def check(got, rows):
    n, root = brute(rows)
    seen = {}
    for (i, t), k, r in zip(rows, n, root, strict=True):
        seen.setdefault((i, t), []).append((k, r))
    assert len(got) == len(rows)
    assert sorted((r.key if r.key is not None else -1, r.n_links) for r in got) == sorted((i if i is not None else -1, k) for (i, _), k in zip(rows, n, strict=True))
    mine = sorted(sorted((r.key if r.key is not None else -1) for r in got if r.class_id == c) for c in {r.class_id for r in got})
    want = sorted(sorted((rows[i][0] if rows[i][0] is not None else -1) for i in range(len(rows)) if root[i] == c) for c in set(root))
    assert mine == want


def test_links_and_classes_match_brute_force(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], SCHEMA).repartition(3)
    check(J.join(docs).collect(), rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK_ROWS", 4)
    rows = data()
    check(J.join(spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], SCHEMA)).collect(), rows)


def test_small_groups_in_blocks_by_bytes(spark, monkeypatch):
    """Groups of two and three long texts, some of whose blocks are empty."""
    monkeypatch.setattr(groups, "BLOCK_BYTES", 1000)
    rng = random.Random(13)
    rows = []
    for g in range(30):
        base = [f"w{g}x{rng.randrange(10_000)}" for _ in range(150)]
        rows += [(len(rows) + k, " ".join([*base, f"end{k}"])) for k in range(2 + g % 2)]
    check(J.join(spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], SCHEMA)).collect(), rows)


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1080)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    loops = {a for a, b in pairs if a == b} - set(got)
    assert got == {x: find(x) for x in root if x not in loops}


def test_pruning_keeps_similar_pairs():
    limits = J.least_equal(4, 5)
    assert all(limits[n] < 0.8 * n for n in limits) and limits[128] > 70
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(300):
        base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        sets += [base[:360], base[40:]]  # similarity 0.8
    sig = S.signatures(np.concatenate(sets), np.array([360] * 600), J.VALUES)
    a = np.arange(0, 600, 2)
    assert len(J.similar(sig, a, a + 1, limits)) == 300
    assert len(J.similar(sig, a[:-1], a[1:], limits)) == 0
    bands = S.band_hashes(sig, J.ROWS)
    assert (bands[a] == bands[a + 1]).any(axis=1).all()


def test_first_of_each_class(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], SCHEMA)
    got = J.first_of_each(docs)
    assert got.columns == docs.columns
    root = brute(rows)[1]
    want = [min(((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == c)) for c in set(root)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want)
