import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from txnrules.llm import bpe, line_dedup
from txnrules.llm import quality_classifier as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "re", "es"]) for _ in range(rng.randrange(1, 4)))
    line = lambda n, end="": " ".join(word() + end for _ in range(n))
    item = line(14)
    rows, labels = [], []
    for i in range(220):
        bad = i % 4 == 0
        rows.append((i, "\n".join(line(rng.randrange(8, 30), "$$$" if bad else "") for _ in range(rng.randrange(1, 4)))))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(301, rows[1][1]), (302, rows[2][1] + " " + item), (303, line(60) + "\n" + rows[3][1].split("\n")[0]), (304, None), (305, "")]
    text = line(200)
    rows += [(306, text), (307, text.replace(" ", "\n", 3)), (308, line(40) + " " + item + " " + line(30))]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, line(12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def grouped(n, similar):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if similar(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def brute_lines(docs):
    at = [(i, k, x, line_dedup.normal(x.encode())) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    sets = [{n.decode()[j : j + 7] for j in range(max(1, len(n.decode()) - 6))} if n else set() for *_, n in at]
    root = grouped(len(at), lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    cleaned = [(i, t, None if t is None else "\n".join(x for k, (j, _, x, _) in enumerate(at) if j == i and root[k] == k)) for i, t in docs]
    return [(i, new) for i, old, new in cleaned if not words(old) or words(new)]


def brute_near(docs):
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in docs]
    root = grouped(len(docs), lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return [d for k, d in enumerate(docs) if root[k] == k]


def brute_clean(docs, items):
    grams = {tuple(w[j : j + 10]) for t in items for w in [words(t)] for j in range(len(w) - 9)}
    return [(i, t) for i, t in docs if not any(tuple(words(t)[j : j + 10]) in grams for j in range(len(words(t)) - 9))]


def test_run_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(kept) < docs.count() and sum((i in kept) == bool(q) for i, q in labels.items()) > 0.95 * len(labels)
    want = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in kept]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute_clean(brute_near(brute_lines(want)), items)
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == sorted(i for i, _ in want)
    for i, t in want:
        ids = tokenizer.encode(t or "").ids
        assert (list(got[i].ids), got[i].n_tokens, got[i].text) == (ids, len(ids), t or "")
    assert 302 not in got and 308 not in got


def test_exact_copies_leave_no_husks(spark, tmp_path):
    """The lines stage empties copies; of what it empties, and of other texts without words, one row at most comes out."""
    rng = random.Random(43)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    copied, others = "\n".join(line(20) for _ in range(3)), [line(30) for _ in range(5)]
    rows = [(i, copied) for i in range(40)] + [(100 + i, t) for i, t in enumerate(others)] + [(200, ""), (201, " \t"), (202, "?!"), (203, "?!")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, line(14))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(i for i, r in got.items() if r.text.strip()) == [0, 100, 101, 102, 103, 104, 202]
    assert sum(r.n_tokens == 0 for r in got.values()) == 1 and len(got) == 8


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_held_out_labels_are_not_learnt(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert 0 < labels.filter(~Q.held_out()).count() < labels.count()


def test_copies_with_other_line_ends_are_near_duplicates(spark, tmp_path):
    """Two texts of the same words in lines of other lengths share no line, so the lines stage keeps both, and the next one keeps one."""
    words = [f"w{k * 7919 % 1000}x{k}" for k in range(400)]
    wrap = lambda n: "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    docs = spark.createDataFrame([(1, wrap(37)), (2, wrap(50)), (3, "quite another text of its own\nin two lines")], "doc_id long, text string")
    kept = corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, len(r.text.split())) for r in kept.collect()) == [(1, 400), (2, 400), (3, 9)]
    kept = spark.createDataFrame(kept.collect(), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, kept, str(tmp_path)).collect()) == [1, 3]
