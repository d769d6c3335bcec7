import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from txnrules.llm import alignment as A
from txnrules.llm.stretches import stretches

PATHS = A.default_vocabularies()
SCHEMA = "doc_id long, text string, rid string, pair int, n string, key string"
PARTS = ["word", "Words,", "antidisestablishment", " ", "  ", "\n", "\t", " \n ", "\x1c", "\x85", "\xa0", "　", " ", "é", "日本語", "👩‍👩‍👧", "12345", "...", "'s", "x", "haha" * 5, "<s>", "</s>", "<0x41>", "<|endoftext|>", "ﬁ", "é", "᠎", "\0", "a b"]
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n a\n", "a▁b", "▁", "x" * 3000, "ab" * 500 + " end", "<unk> <s>", "﻿q", "a\x1c b", "9" * 400, " 　 ", "\U0010ffff"]


def tokens():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(texts):
    """Per text (A ids, B ids, groups); whole texts through the libraries, one walk over the ends."""
    a, b = tokens()
    letters = A.read_vocabulary(PATHS[0])
    at, joined = letters["token_at"], letters["token_bytes"].tobytes()
    out = []
    for t in texts:
        x, y, groups = [], [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            piece = [b.id_to_piece(k) for k in y]
            x_bytes = [joined[at[k] : at[k + 1]] for k in x]
            y_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(y, piece, strict=True)]
            if not b"".join(x_bytes) == b"".join(y_bytes) == (" " + t).encode():
                x, y = [], []
            else:
                i = j = p = q = 0
                group = ([], [])
                while i < len(x) or j < len(y):
                    if p <= q and i < len(x):
                        p += len(x_bytes[i])
                        group[0].append(x[i])
                        i += 1
                    else:
                        q += len(y_bytes[j])
                        group[1].append(y[j])
                        j += 1
                    if p == q:
                        groups.append(group)
                        group = ([], [])
        out.append((x, y, groups))
    return out


def rows(texts):
    found = brute(texts)
    count = Counter(p for _, _, groups in found for p in {(i, j) for x, y in groups for i in x for j in y})
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    for x, y, groups in found:
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (len(x), len(y), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else "")


def data():
    rng = random.Random(11)
    return [*ODD, *["".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 40))) for _ in range(300)], None, ODD[5], "word word Words, word", "word word Words, word"]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 40 != 39 else None, t, "r", 1, "n", "k") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def test_stretches_make_up_the_text():
    for t in [x for x in data() if x]:
        assert " ".join(stretches(t)) == t


@pytest.mark.parametrize("piece", [1, 2, 7, A.PIECE])
def test_merge_path_pieces_give_the_groups(monkeypatch, piece):
    monkeypatch.setattr(A, "PIECE", piece)
    rng = np.random.default_rng(5)
    for _ in range(60):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, 40)), end)) for _ in range(2))
        in_a, in_b = A.groups(a, b)
        common = np.intersect1d(a, b)
        assert in_a.tolist() == [int((common < e).sum()) for e in a] and in_b.tolist() == [int((common < e).sum()) for e in b]
        i, j = A.diagonals(a, b, np.arange(0, len(a) + len(b) + 1, piece))
        assert (np.diff(i + j) <= piece + 1).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()


def test_large_groups_are_not_spelled_out():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    in_a, in_b = np.repeat([0, 1], [100, 200]), np.repeat([0, 1], [5, 195])
    got = {}
    for g, p, n in zip(*A.pairs_of(a, b, in_a, in_b, 2, 7), strict=True):
        got[g, p] = got.get((g, p), 0) + n
    want = Counter((g, x * 7 + y) for g in (0, 1) for x in a[in_a == g] for y in b[in_b == g])
    assert got == dict(want)


@pytest.mark.parametrize("frequent,memo,piece", [(A.FREQUENT, A.MEMO, A.PIECE), (30, 5, 3), (0, A.MEMO, 64)])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, frequent, memo, piece):
    for name, value in (("FREQUENT", frequent), ("MEMO", memo), ("PIECE", piece), ("CHARS_AT_ONCE", 400 if memo == 5 else 500_000), ("LONG", 2000)):
        monkeypatch.setattr(A, name, value)
    texts = data()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = A.op11_merge_path_alignment(spark, str(tmp_path)).collect()
    want = [((i if i % 40 != 39 else None), *r) for i, r in enumerate(rows(texts))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for x, y in zip(sorted((tuple(r[c] for c in columns) for r in got), key=key), sorted(want, key=key), strict=True):
        assert x == y


def test_given_documents(spark):
    """Stretches give what whole texts give, on 200 given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = dict(zip([r.doc_id for r in docs.collect()], rows([r.text or "" for r in docs.collect()]), strict=True))
    for r in A.align(docs, *PATHS).collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.digest) == want[r.key]


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0

