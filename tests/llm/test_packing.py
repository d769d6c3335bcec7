import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnrules.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, role string, ids int, start string, sequence int, key string"
ODD = ["it's WE'LL 'tis ''s 's's !'re I've rock'n'roll 'd'", "ΑΣ Σ ΣΑΣ İ ß ǅ", "é 가 क़", "12 3.5½ ⅷ٣", "a b c\x1cd\x85e᠎f​g", "<|endoftext|> x<|startoftext|>y", "͸ z \U0003fc36", "日本語テキスト。中文", "👩‍👩‍👧 ok", "", " ", "\n\n", "'", "'l", "'r", "a'", "don't'", "x" * 5000, "'s", "́a", "ﬁ ﷺ"]


def wanted(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_ids_equal_the_library():
    rng = random.Random(13)
    parts = [*ODD, "word", "Word,", "'s", "'", "'ll", "5", " ", "\t", "é", "É", "!", "—", "Σ", "́", "ю"]
    texts = [*ODD, *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]]
    encoder = P.Encoder(PATH)
    got = [x.tolist() for a, b in P.batches_of(texts) for x in encoder.encode(texts[a:b])]
    for t, x, y in zip(texts, got, wanted(texts), strict=True):
        assert x == y, t


def test_every_kind_of_character_equals_the_library():
    encoder = P.Encoder(PATH)
    texts = ["".join(f"a{chr(c)}1{chr(c)}{chr(c)} !{chr(c)}'s" for c in range(a, min(a + 64, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 64)]
    got = [x for a in range(0, len(texts), 200) for x in encoder.encode(texts[a : a + 200])]
    assert [x.tolist() for x in got] == wanted(texts)


def test_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(P, "MEMO", 3)
    encoder = P.Encoder(PATH)
    for t in (["one two three four five"], ["six one"], ["two two"]):
        assert [x.tolist() for x in encoder.encode(t)] == wanted(t)


def data():
    rng = random.Random(14)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ing", "re", "es"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(int(rng.paretovariate(0.6)) % 9000)) for _ in range(400)] + ODD + [None, None, texts_long()]
    return [(i if i % 50 else None, t, rng.choice(["user", "assistant", None]), 1, "s", 2, "k") for i, t in enumerate(texts)] + [(7, "same row", "user", 1, "s", 2, "k")] * 3


def texts_long():
    return "long text of many words, " * 20_000


def check(rows, docs, bears, tokens, segments, loss):
    """The pieces make up every example once, sequences are gapless and within the limits; returns the padding."""
    left = sorted(((-1 if k is None else k), tuple(ids)) for (k, t, *_), ids in zip(docs, wanted([d[1] or "" for d in docs]), strict=True))
    by_doc = {}
    for r in rows:
        by_doc.setdefault((-1 if r.key is None else r.key), []).append((r.start, np.frombuffer(r.ids, "<i4").tolist(), r.doc_tokens))
    got = sorted((k, i) for k, pieces in by_doc.items() for i in [x for _, ids, _ in pieces for x in ids])
    assert got == sorted((k, i) for k, ids in left for i in ids)
    for k, pieces in by_doc.items():
        mine = [ids for key, ids in left if key == k]
        if len(mine) == 1:
            whole = [x for _, ids, _ in sorted(pieces) for x in ids]
            assert tuple(whole) == mine[0] and {n for *_, n in pieces} == {len(whole)}
            assert [s for s, *_ in sorted(pieces)] == np.cumsum([0, *[len(i) for _, i, _ in sorted(pieces)]])[:-1].tolist()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        sizes = [len(r.ids) // 4 for r in pieces]
        assert [r.offset for r in pieces] == np.cumsum([0, *sizes])[:-1].tolist() and min(sizes) > 0
        assert sum(sizes) <= tokens and len(pieces) <= segments and sum(r.loss_tokens for r in pieces) <= loss
        assert sum(sizes) == tokens or sum(sizes) & (sum(sizes) - 1) == 0
    assert sum(r.loss_tokens for r in rows) == sum(len(ids) for d, ids in zip(docs, wanted([d[1] or "" for d in docs]), strict=True) if bears(d))
    return sequences


@pytest.mark.parametrize("pool", [3, 2048])
def test_documents(spark, pool):
    docs = data()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    sequences = check(P.pack(frame, PATH, pool=pool).collect(), docs, lambda d: True, P.TOKENS, P.SEGMENTS, P.LOSS)
    assert sum(sum(len(r.ids) for r in s) // 4 < 4096 for s in sequences.values()) <= 3 * 12


def test_three_limits(spark):
    docs = data()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(2)
    loss = F.col("role") == "assistant"
    sequences = check(P.pack(frame, PATH, loss=loss, tokens=1024, segments=9, loss_tokens=300).collect(), docs, lambda d: d[2] == "assistant", 1024, 9, 300)
    assert np.mean([sum(len(r.ids) for r in s) == 4 * 1024 for s in sequences.values()]) > 0.5


def test_a_vector_that_fits_the_room_goes_first():
    packer = P.Packer(100, 3, 50, 10, 0)
    for key, n, bears in ((1, 60, False), (2, 50, True), (3, 40, True), (4, 10, False)):
        packer.add((key, 0, np.zeros(n, np.int32), bears, n))
    assert [(p[0], len(p[2])) for p in packer.fill()] == [(2, 50), (4, 10), (1, 40)]  # 50 bear all the loss there is room for; then what bears none, cut at the end


def test_query(spark, tmp_path):
    docs = data()[:60]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op13_vector_packing(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == sum(map(len, wanted([d[1] or "" for d in docs])))
    one = next(r for r in rows if r.doc_id == 7 and r.length == r.doc_tokens)
    assert one.ids_crc32 == zlib.crc32(np.array(wanted([docs[7][1] or ""])[0], "<u4").tobytes())
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame(docs, SCHEMA), PATH, tokens=0)
    assert P.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
