"""Every query on a small folder with nulls, empty texts, ties, repeated rows and clashing columns, and on empty tables."""

import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline

NAMES = sorted(n for n in entry.queries() if re.match(r"op\d+_", n))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rid string, node int, row string, score int, half string, h int"
PAGES = "page_id long, url string, html string, text int, key string"


def write(spark, path, docs, labels, items, pages, vectors=()):
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int, key string").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(*d, len(d[1] or ""), "k", "r", 1, "row", 2, "x", 3) for d in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, key string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(pages, PAGES).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(51)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "re", "es"]) for _ in range(rng.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, "\n".join(line(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 4))), "en", f"host{i % 3}.org") for i in range(60)]
    docs += [docs[1], docs[1], (70, None, None, None), (71, "", "en", "a"), (None, docs[2][1], None, "b"), (None, None, None, None), (72, "é " * 30_000, "fr", "c"), (73, "?!", "en", "d")]
    labels = [(i, i % 2, 0, "x") for i in range(40)] + [(None, 1, 0, None), (3, None, None, None), (4, 0, 0, None), (4, 0, 0, None)]
    items = [(1, docs[5][1], "k"), (1, docs[5][1], "k"), (2, None, None), (None, "zz yy", None), (3, "", "k")]
    pages = [(1, "u", "<body><article><h1>Title</h1><p>Some text of the story.</p></article></body>", 3, "k"), (None, None, None, None, None), (2, "u", "", 1, "k"), (2, "u", "", 1, "k")]
    vectors = [(i, [rng.random() for _ in range(9)], 1, "k") for i in range(40)] + [(None, None, None, None), (41, [], 1, "k"), (42, [None] * 9, 1, "k"), (1, [0.5] * 9, 1, "k"), (None, [0.5] * 9, 1, "k")]
    return write(spark, tmp_path_factory.mktemp("small"), docs, labels, items, pages, vectors), docs, pages


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def test_thirteen_queries():
    assert len(NAMES) == 13


@pytest.mark.parametrize("name", NAMES)
def test_small_and_empty_folders(spark, folder, empty, name):
    path, docs, pages = folder
    query = entry.queries()[name]
    rows = query(spark, path).collect()
    assert query(spark, empty).count() == 0
    if name == "op3_text_density":
        assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "Title Some text of the story.", 29), (2, "", 0), (2, "", 0)]
        return
    if name == "op12_bit_sliced_whitening":
        assert len(rows) == 8 * 42 and {r.n for r in rows} == {42} and rows[0].identity_error < 1e-9
        return
    if name == "op13_vector_packing":
        whole = {(r.doc_id, r.start): r for r in rows}
        assert {r.doc_id for r in rows} == {i for i, *_ in docs} and whole[70, 0].doc_tokens == whole[71, 0].doc_tokens == 1
        return
    lines = sum(t.count("\n") + 1 for _, t, _, _ in docs if t is not None)
    assert len(rows) == (lines if name == "op2_line_dedup" else len(docs))
    if name != "op2_line_dedup":
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == sorted(i if i is not None else -1 for i, *_ in docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    if name == "op1_ngram_decontamination":
        assert by[5][0].n_hit == by[5][0].n_words > 0 and by[70][0].n_words == 0
    if name == "op2_line_dedup":
        assert all(sum(r.kept for r in rows if r.class_id == c) == 1 for c in {r.class_id for r in rows if r.class_id is not None})
    if name == "op5_bayesian_jaccard":
        assert {r.n_links for r in by[1]} == {2} and len({r.class_id for r in by[1]}) == 1 and by[2][0].n_links == 1
    if name == "op6_virtual_slots":
        loads = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
        assert sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows))) and sum(loads) == sum(len((t or "").encode()) + 1 for _, t, _, _ in docs)
    if name == "op9_kneser_ney":
        assert by[70][0].lang_pred == by[71][0].lang_pred == "und" and by[1][0].lang_pred == "en"
    if name == "op11_merge_path_alignment":
        assert by[70][0].n_a == by[71][0].n_links == 0 and by[71][0].groups_sha256 == "" and by[1][0].n_links >= by[1][0].n_groups > 0
    if name == "op10_host_rules":
        assert by[71][0].base_failed and not by[71][0].kept


def test_pipeline_with_more_columns_and_on_empty_tables(spark, folder, empty):
    path, docs, _ = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, path)
        assert kept.columns == table.columns and kept.count() <= len(docs), name
    got = corpus_pipeline.run(spark, path).collect()
    assert len({(r.doc_id, r.text) for r in got}) == len(got) and 0 < len(got) < len(docs)
    assert corpus_pipeline.run(spark, empty).count() == 0
