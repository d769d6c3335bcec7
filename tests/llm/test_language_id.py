import math
import random
from collections import Counter, defaultdict

import numpy as np

from txnrules.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, key int"
SYLLABLES = {"aa": ["th", "ing", "er", "on"], "bb": ["sch", "ein", "ü", "ber"], "cc": ["eau", "é", "oi", "que"]}


def data(n=120):
    rng = random.Random(4)
    make = lambda x: " ".join("".join(rng.choice(SYLLABLES[x]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 30)))
    return [(i, make(x := rng.choice(list(SYLLABLES))), x) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], SCHEMA)


def brute_entropy(rows, text):
    """Interpolated Kneser-Ney from the definition, with dictionaries of n-gram strings."""
    fold = lambda t: "\1\1\1" + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split(" ")).strip()
    four = Counter(s[i : i + 4] for t in rows for s in [" ".join(fold(t).split())] for i in range(len(s) - 3))
    counts = {4: four}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, kinds, discount = {}, {}, {}
    for k, c in counts.items():
        total[k], kinds[k] = defaultdict(float), defaultdict(int)
        for g, n in c.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
    return counts, total, kinds, discount, fold


def test_probabilities_match_the_definition(spark):
    rows = [t for _, t, x in data() if x == "aa"]
    model = L.train(frame(spark, [(i, t, "aa") for i, t in enumerate(rows)]), calibration=0)
    counts, total, kinds, discount, fold = brute_entropy(rows, "")
    floor = 1 / (len(counts[1]) + 1)

    def p(g, k):
        if not k:
            return floor
        g = g[-k:]
        if g[:-1] not in total[k]:
            return p(g, k - 1)
        return max(counts[k].get(g, 0) - discount[k], 0) / total[k][g[:-1]] + discount[k] * kinds[k][g[:-1]] / total[k][g[:-1]] * p(g, k - 1)

    for text in ("thing eron", "on th xq", "zz", rows[3]):
        s = fold(text)
        want = -sum(math.log(p(s[i - 3 : i + 1], 4)) for i in range(3, len(s))) / (len(s) - 3)
        assert abs(model.entropies([text])[0, 0] - want) < 1e-3


def test_accuracy_nulls_and_empty(spark):
    docs = frame(spark, data(300) + [(500, None, "aa"), (501, "12 !", "bb"), (502, "thing", None), (None, "thing er", "aa"), (1, "eau que", "cc"), (503, "th " * 40_000, "aa")])
    model = L.train(docs.filter(~L.held_out()))
    got = L.identify(docs, model).collect()
    assert len(got) == docs.count()
    truth = {i: x for i, _, x in data(300)}
    assert np.mean([r.lang_pred == truth[r.key] for r in got if r.key is not None and 2 <= r.key < 300]) > 0.97
    by = {r.key: r for r in got}
    assert (by[500].lang_pred, by[500].score, by[501].lang_pred) == ("und", 0.0, "und")
    assert all(0 <= r.score <= 1 for r in got)
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_foreign_text_is_rejected(spark):
    model = L.train(frame(spark, data(300)))
    _, _, rejected = model.predict(["θεωρία και πράξη του λόγου", data(3)[0][1]])
    assert rejected == [True, False]


def test_empty_and_blank_languages_are_learnt(spark):
    rows = [(i, t, {"aa": "", "bb": " ", "cc": "%=/"}[x]) for i, t, x in data(90)]
    model = L.train(frame(spark, rows))
    assert model.languages == ["", " ", "%=/"]
    got = {r.key: r.lang_pred for r in L.identify(frame(spark, rows), model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.97


def test_arrays_come_in_runs(spark, monkeypatch):
    rows = frame(spark, data(60))
    whole = L.train(rows)
    monkeypatch.setattr(L, "RUN", 7)
    parts = L.train(rows)
    assert (whole.entropies(["thing ein eau"]) == parts.entropies(["thing ein eau"])).all() and whole.size == parts.size


def test_whole_query_matches_the_definition(spark, tmp_path, monkeypatch):
    """Every prediction and score from dictionaries of n-gram strings; without calibration documents the temperature is 1."""
    import zlib

    monkeypatch.setattr(L, "CALIBRATION", 0)
    monkeypatch.setattr(L.train, "__defaults__", ("doc_id", "text", "lang", 0))
    rows = data(90) + [(200, "", "aa"), (201, None, "bb"), (202, "42", None), (203, "thing Eau", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    models = {x: brute_entropy([t for i, t, lang in rows if lang == x and t and not held(i)], "") for x in SYLLABLES}

    def entropy(text, model):
        counts, total, kinds, discount, fold = model
        floor = 1 / (len(counts[1]) + 1)

        def p(g, k):
            if not k:
                return floor
            g = g[-k:]
            if g[:-1] not in total[k]:
                return p(g, k - 1)
            return max(counts[k].get(g, 0) - discount[k], 0) / total[k][g[:-1]] + discount[k] * kinds[k][g[:-1]] / total[k][g[:-1]] * p(g, k - 1)

        s = fold(text)
        return -sum(math.log(p(s[i - 3 : i + 1], 4)) for i in range(3, len(s))) / (len(s) - 3)

    got = {r.doc_id: r for r in L.op9_kneser_ney(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        assert got[i].held_out == held(i)
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        e = {x: entropy(t, m) for x, m in models.items()}
        best = min(sorted(e), key=e.get)
        share = math.exp(-e[best]) / sum(math.exp(-v) for v in e.values())
        assert got[i].lang_pred == best and abs(got[i].score - share) < 1e-3
