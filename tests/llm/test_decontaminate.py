import random
import re

from txnrules.llm import decontaminate as D

DOCS = "doc_id long, text string, spans int, row string, key string"


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, n=10):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item).lower() if item is not None else "null")
    return len(ws), sorted(hit), sorted(found)


def data():
    rng = random.Random(3)
    vocab = ["the", "of", "É", "a1", "Ünd", "x", "wh", "no"]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, line(rng.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (None, "zz yy"), (93, "zz yy"), (1, "zz yy")]
    docs = [(i, line(rng.randrange(40))) for i in range(50)] + [(60, None), (61, ""), (62, items[3][1].upper() + ", " + line(5)), (None, "a ZZ-yy b"), (62, "zz")]
    docs += [(70, (line(300) + " ") * 60 + items[4][1])]
    return docs, items


def test_scan_matches_brute_force_with_one_index_and_with_several(spark):
    docs, items = data()
    left = spark.createDataFrame([(i, t, 1, "r", "k") for i, t in docs], DOCS)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i if i is not None else -1, *map(str, brute(t, items))) for i, t in docs)
    for most in (10**6, 40):
        got = D.scan(left, right, max_windows=most).collect()
        assert sorted((r.key if r.key is not None else -1, str(r.n_words), str([p for s in r.spans for p in range(s.start, s.end)]), str(list(r["items"]))) for r in got) == want


def test_removal(spark):
    left = spark.createDataFrame([(1, "keep this. One two, three! And this", 0, "", ""), (2, "clean", 0, "", ""), (3, None, 0, "", "")], DOCS)
    right = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    kept = D.without_documents(left, right)
    assert kept.columns == left.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in D.without_spans(left, right).collect()}
    assert cut == {1: "keep this. ! And this", 2: "clean", 3: None}


def test_empty_tables(spark):
    left = spark.createDataFrame([(1, "a b", 0, "", "")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [list(r.spans) for r in D.scan(left, none).collect()] == [[]]
    assert D.scan(left.limit(0), none).count() == 0
