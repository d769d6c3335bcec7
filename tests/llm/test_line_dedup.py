import random

import numpy as np
import pyarrow as pa

from txnrules.llm import groups
from txnrules.llm import line_dedup as D
from txnrules.llm import shingles as S

SCHEMA = "doc_id long, text string, rid string, node int, gone int"


def data():
    rng = random.Random(21)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    bases = [make(rng.randrange(6, 40)) for _ in range(15)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(bases) if rng.random() < 0.5 else make(rng.randrange(1, 30))
            if rng.random() < 0.4 and len(line) > 60:
                at = rng.randrange(len(line))
                line = line[:at] + "z" + line[at + 1 :]
            lines.append(line.upper() if rng.random() < 0.1 else line)
        docs.append((i, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n \n"), (53, "ab"), (54, "AB \n ab"), (None, bases[0] + "\nlast é"), (3, "last É"), (60, "word " * 20_000)]
    return docs


def brute(docs):
    """Kept lines by the definition, rows ordered by (id is null, id, row)."""
    rows = [(i is None, i or 0, r, k, D.normal(x.encode()), x) for r, (i, t) in enumerate(docs) if t is not None for k, x in enumerate(t.split("\n"))]
    rows.sort()
    sets = [{n.decode()[j : j + 7] for j in range(max(1, len(n.decode()) - 6))} if n else set() for *_, n, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {}
    for k, r in enumerate(rows):
        if find(k) == k:
            kept.setdefault(r[2], []).append((r[3], r[5]))
    return {r: "\n".join(x for _, x in sorted(kept.get(r, []))) for r, (_, t) in enumerate(docs) if t is not None}


def run(spark):
    docs = data()
    frame = spark.createDataFrame([(i, t, "r", 5, 6) for i, t in docs], SCHEMA).coalesce(1)
    got = D.dedup(frame)
    assert got.columns == frame.columns
    want = sorted(((i if i is not None else -1), brute(docs).get(r)) for r, (i, _) in enumerate(docs) if docs[r][1] is not None)
    rows = got.collect()
    assert len(rows) == len(docs)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in rows if r.text is not None) == want


def test_matches_brute_force(spark):
    run(spark)


def test_matches_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK_ROWS", 3)
    run(spark)


def test_one_line_of_each_class_stays(spark):
    docs = D.numbered(spark.createDataFrame(data(), "doc_id long, text string"))
    rows = D.line_table(docs).collect()
    assert len(rows) == sum(len(t.split("\n")) for _, t in data() if t is not None)
    for c in {r.class_id for r in rows if r.class_id is not None}:
        assert sum(r.kept for r in rows if r.class_id == c) == 1


def test_pairs_at_the_threshold_are_candidates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (3000, 90), dtype=np.uint64)
    sets = np.stack([base[:, :80], base[:, 10:]], axis=1)  # similarity 70 / 90
    sets[:, 1, -1] = base[:, 0]
    sets[:, 1, -2] = base[:, 1]  # 72 / 88, the least above 0.8
    bands = S.band_hashes(S.signatures(sets.ravel(), np.full(6000, 80), D.VALUES), D.ROWS)
    assert (bands[::2] == bands[1::2]).any(axis=1).sum() >= 2999


def test_empty_table(spark):
    assert D.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_million_equal_lines_take_seconds(spark):
    import time

    n = 1_000_000
    docs = spark.createDataFrame([(1, "one line of words, and more of it\n" * n, "r", 5, 6), (2, "another line that is quite different\n" * n + "and its end", "r", 5, 6)], SCHEMA).coalesce(1).cache()
    docs.count()
    began = time.time()
    rows = D.dedup(docs).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert [r.text for r in rows] == ["one line of words, and more of it\n", "another line that is quite different\nand its end"]


def test_small_buckets_together_equal_brute_force():
    rng = random.Random(17)
    stretches = ["".join(rng.choices("abcdefgh éß", k=rng.randrange(8, 60))) for _ in range(30)]
    groups = [[f"xy{k}".encode() for k in range(2)], [b"same text twice", b"same text twice"], [b"ab", b"ab", b"abc"]]
    for size in [2, 2, 3, 4, 7, 15, 40, D.SMALL] * 3:
        base = rng.sample(stretches, 6)
        lines = [list(base if rng.random() < 0.7 else rng.sample(stretches, 6)) for _ in range(size)]
        for x in lines:
            for _ in range(rng.randrange(3)):
                x[rng.randrange(6)] = rng.choice(stretches)[: rng.randrange(5, 60)]
        groups.append([" ".join(x).encode() for x in lines])
    flat, group = [x for g in groups for x in g], np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    found = D.groups_joined(*S.char_shingles(flat), group)
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in (x.decode() for x in flat)]
    root, begin, similar = list(range(len(flat))), 0, 0
    for g in groups:
        own = range(begin, begin + len(g))
        for i in own:
            for j in own:
                if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    similar += 1
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        begin += len(g)
    assert found.tolist() == root and similar > 300
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    table = pa.table({"node": np.arange(len(flat)), "line": pa.array(flat, pa.binary())})
    (told,) = D._verify(table, begin.tolist(), np.ones(len(flat), bool))
    assert sorted(zip(*told.to_pydict().values(), strict=True)) == [(k, r) for k, r in enumerate(root) if k != r]
