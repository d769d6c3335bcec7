import math
import pickle
import random
import re
import string
from collections import Counter

import numpy as np

from txnrules.llm import secrets_scan as S

SCHEMA = "doc_id long, text string, base string, spans int, key string"
HEXES = "0123456789abcdef"
ALNUM = string.ascii_letters + string.digits


def brute(text):
    rules = {
        "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    found = [(m.start(), k, m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]
    return sorted(found, key=lambda x: (x[0], list(rules).index(x[1])))


def brute_candidates(text):
    base = brute(text)
    return [m.span() for m in re.finditer("[A-Za-z0-9+/_.=-]{6,}", text) if not any(a < m.end() and m.start() < b for a, _, b in base)]


def test_base_rules_and_candidates_match_brute_force():
    rng = random.Random(31)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "x" * 30, "AKIA", "AKIA" + "Q1" * 8, "deadbeef" * 4, "0f" * 11, "é", "ſ", "\n", ".", "-", "ABCDEF", "9" * 25]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + ["", "é"]
    for taken, spelled, base in S.pieces(texts):
        for t, b in zip(taken, base, strict=True):
            assert [(s["start"], s["kind"], s["end"]) for s in b] == brute(t), t
        found = S.Candidates(spelled, base, taken)
        got = {}
        for k, (at, n) in zip(found.text.tolist(), zip((found.start - found.begin[found.text]).tolist(), found.size.tolist(), strict=True), strict=True):
            at = len(spelled[k][:at].decode())
            got.setdefault(k, []).append((at, at + n))
        assert all(got.get(k, []) == brute_candidates(t) for k, t in enumerate(taken))
        pairs = Counter()
        for t in taken:
            for a, b in brute_candidates(t):
                run = [S.ALPHABET.index(c) for c in t[a:b].encode()]
                pairs.update(zip([S.END, *run], [*run, S.END], strict=True))
        counted = found.pairs().reshape(S.SYMBOLS + 1, S.SYMBOLS + 1)
        assert {(int(a), int(b)): int(counted[a, b]) for a, b in zip(*np.nonzero(counted), strict=True)} == dict(pairs)


def unigram(fit, held):
    """Mean log-likelihood of held strings under one distribution of the characters and the end."""
    n = Counter("".join(fit))
    total = sum(n.values()) + len(fit)
    return np.mean([sum(math.log((n[c] + 0.5) / (total + 35)) for c in s) + math.log(len(fit) / total) for s in held])


def formats():
    rng = random.Random(32)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {
        "fixed": [of(HEXES, 40) for _ in range(300)],
        "prefix": ["ghk_" + of(ALNUM, 36) for _ in range(300)],
        "parts": [f"{of(string.ascii_uppercase, 4)}-{of(string.digits, 4)}-{of(string.ascii_lowercase, rng.randrange(6, 14))}" for _ in range(300)],
        "loop": ["k-" + of("ab", rng.randrange(8, 30)) for _ in range(300)],
    }


def test_automata_have_states_of_position_prefix_and_length():
    least = {"fixed": 41, "prefix": 41, "parts": 11, "loop": 3}
    for name, strings in formats().items():
        a = S.Automaton(strings[:240])
        assert least[name] <= a.states < 120, (name, a.states)
        assert a.score_texts(strings[240:])[0].mean() > unigram(strings[:240], strings[240:]) + 3, name
        if name != "loop":  # a wrong length or a wrong prefix is far less likely
            good = a.score_texts(strings[240:])[0] / [len(s) for s in strings[240:]]
            bad = [s[3:] for s in strings[240:]] + [s[::-1] for s in strings[240:] if name != "fixed"]
            assert (a.score_texts(bad)[0] / [len(s) for s in bad]).max() < np.quantile(good, 0.05), name


def test_log_likelihoods_are_a_distribution():
    a = S.Automaton(["ab", "ac", "b", "abb", "ab"])
    assert np.allclose(np.exp(a.log_p[:-1]).sum(axis=1), 1, atol=1e-9)


def documents():
    rng = random.Random(33)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    plain = lambda n: " ".join(of("theronigsa", rng.randrange(2, 15)) for _ in range(n))
    make = [lambda: "ghk_" + of(ALNUM, 36), lambda: of(string.ascii_uppercase, 4) + "-" + of(string.digits, 6) + "-" + of(string.ascii_uppercase, 4), lambda: of(HEXES, 18)]
    rows, bare = [], {}
    for i in range(240):
        rows.append((i, f"{plain(20)} {['password=', 'token = ', 'api_key: '][i % 3]}{make[i % 3]()} {plain(9)}"))
    for i in range(60):
        bare[1000 + i] = make[i % 3]()
        rows.append((1000 + i, f"é {plain(6)} {bare[1000 + i]} {plain(6)}"))
    for i in range(120):  # looks like none of the formats
        rows.append((2000 + i, f"{plain(9)} {[f'4{rng.randrange(10**14, 10**15)}', f'ab.{i}@mail{i % 9}.example.com', f'{rng.randrange(256)}.{rng.randrange(256)}.10.{i}', f'https://www.{of('abcdef', 9)}.com/{i}/{of('xyz', 5)}.html'][i % 4]} {plain(9)}"))
    return rows + [(3001, None), (3002, ""), (None, "token=abcdef"), (0, "4111111111111111"), (3003, plain(20_000))], bare


def test_learnt_formats_find_bare_credentials(spark):
    """Recall and false spans of planted credentials through the scan: 60 bare ones of three formats that are labelled 80 times each."""
    rows, bare = documents()
    docs = spark.createDataFrame([(i, t, "b", 1, "k") for i, t in rows], SCHEMA)
    got = S.scan(docs, S.learn(S.survey(docs))).collect()
    assert len(got) == len(rows)
    by = {r.key: r.spans for r in got}
    found = [i for i, v in bare.items() if [(s.kind, s.value) for s in by[i]] == [("format", v)]]
    assert len(found) >= 0.9 * len(bare)
    false = [s.value for r in got for s in r.spans if s.kind == "format" and s.value != bare.get(r.key)]
    assert not false
    assert not by[3001] and not by[3002] and not by[3003] and [s.kind for s in by[None]] == ["assign"]
    for i, t in rows:
        if i is not None and i > 0:
            assert [(s.start, s.kind, s.end) for s in by[i] if s.kind != "format"] == brute(t or "")
            assert all(t[s.start : s.end] == s.value for s in by[i] if s.kind == "format")


def test_query(spark, tmp_path):
    rows, bare = documents()
    spark.createDataFrame([(i, t, "b", 1, "k") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op4_grammar_inference(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert sum("format:" in by[i].spans for i in bare) >= 0.9 * len(bare) and sum("format:" in r.spans for r in got) == sum("format:" in by[i].spans for i in bare)
    assert by[None].n_assign == 1 and by[3001].spans == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.scan(docs, S.learn(S.survey(docs))).count() == 0


def test_the_tree_is_not_shipped():
    rng = random.Random(5)
    automaton = pickle.loads(pickle.dumps(S.Automaton(["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(400)])))
    assert not {"arcs", "rest", "depth"} & vars(automaton).keys()
    assert np.isfinite(automaton.score_texts(["0123456789" * 4])[1]).all() and not np.isfinite(automaton.score_texts(["0123456789"])[1]).any()
