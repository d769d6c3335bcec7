import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from txnrules.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
WORDS = ["the", " the", " of", "ing", " thing", "\n", " que", "é", "s"]


def lexicon(tmp):
    path = str(tmp / "lexicon.bin")
    bpe.compile_lexicon(WORDS, bpe.read_vocabulary(PATH), path)
    return bpe.Lexicon(path)


def ids(lex, text):
    return np.frombuffer(b"".join(e[0] for e in lex.encode([text])[0]), np.int32).tolist()


def test_matches_the_tokenizers_library(tmp_path_factory):
    lex = lexicon(tmp_path_factory.mktemp("lex"))

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(" \n\t'stredl\x1c\x85\xa0　é<|>"), st.characters(codec="utf-8")), max_size=60))
    def same(text):
        assert ids(lex, text) == TOKENIZER.encode(text, add_special_tokens=False).ids

    same()
    rng = random.Random(1)
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "they'll  we've\n\n x", "the" * 3000, "".join(rng.choice("thenigrao") for _ in range(20_000))):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids(lex, text) == want
        assert b"".join(e[1] for e in lex.encode([text])[0]).decode() == TOKENIZER.decode(want, skip_special_tokens=False)


def test_transducer_holds_exactly_its_words(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode() for _ in range(900)})
    path = str(tmp_path / "l.bin")
    bpe.compile_lexicon([w.decode() for w in words], bpe.read_vocabulary(PATH), path)
    lex = bpe.Lexicon(path)
    assert lex.places(words).tolist() == list(range(len(words)))
    assert lex.places([b"", b"abcabcabcabc", words[5], b"x"]).tolist() == [-1, -1, 5, -1]
    plain = sum(map(len, words))
    assert len(bpe.transducer(words)["final"]) < plain / 3  # suffixes are shared


def test_merging_together_equals_merging_alone():
    merges = bpe.merges_of(bpe.read_vocabulary(PATH))
    rng = random.Random(7)
    words = ["".join(rng.choice("aaathenigré ") for _ in range(rng.randrange(0, 60))).encode() for _ in range(3000)]
    assert merges.encode_many(words) == [merges.encode(w) if w else [] for w in words]
    assert merges.encode_many([]) == []


def test_summary_keeps_frequent_words():
    counts = bpe.shrunk(bpe.Counter({"a": 9, "b": 5, "c": 1, "d": 1}), 2)
    assert set(counts) == {"a", "b"} and counts["a"] == 8


def test_documents(spark):
    texts = [(1, "the thing"), (2, None), (3, ""), (None, "x"), (1, "the thing"), (4, "é " * 5000)]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in texts], "doc_id long, text string, ids int, key string")
    name = bpe.ship(spark, bpe.frequent_words(docs), PATH)
    got = [(r.key, list(r.ids), r.decoded) for r in bpe.encode(docs, name).collect()]
    assert sorted(got, key=str) == sorted([(i, TOKENIZER.encode(t or "").ids, t or "") for i, t in texts], key=str)
    assert bpe.encode(docs.limit(0), name).count() == 0


def test_query_digests(spark, tmp_path):
    texts = [(1, "Le <|endoftext|> été"), (2, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op7_transducer_bpe(spark, str(tmp_path)).collect():
        text = dict(texts)[r.doc_id] or ""
        want = TOKENIZER.encode(text).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_words_are_what_the_pattern_finds():
    rng = random.Random(17)
    parts = ["word", "Été", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\x85", "\x1c", "12", "½", "!", "...", "日本", "👩‍👩", "é", " 'd", "\u0378", "\u2028", "\xa0", "s", "l"]
    texts = ["", " ", "'", "'s", "a ", " a", "'re've", "it's 'tis", "x\n\n y", "  "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(5000)]
    texts += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}b  {chr(c)}'s" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 64)]
    for a in range(0, len(texts), 300):
        for t, words in zip(texts[a : a + 300], bpe.words_of(texts[a : a + 300]), strict=True):
            assert words == bpe.WORD.findall(t), repr(t)
