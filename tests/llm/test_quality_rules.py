import random
import re

from txnrules.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, source string, words string, n int, host string"


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + d for xs in at.values() if len(xs) > 1 for i in xs for d in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(covered))


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a a a", "a a a a", "a b c a b c", "é x |*#\n\n b\n b\nb", "x" * 100_000, "w " * 20_000]
    texts += [" ".join(rng.choice("ab c\nd\n\x0b&".split(" ") + [" z"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    rows = [(i if i else None, t, None if i % 7 == 0 else f"s{i % 3}", "q", 1, "h") for i, t in enumerate(texts)] * 2
    got = Q.rule_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, *brute(t)) for i, t, *_ in rows)
    assert sorted((r.key if r.key is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_bad_hosts_take_their_documents_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, f"ok{i % 5}", "", 0, "") for i in range(500)]
    rows += [(1000 + i, "too short", "bad", "", 0, "") for i in range(200)] + [(2000, good, "bad", "", 0, "")]
    rows += [(3000, "short", "tiny", "", 0, ""), (3001, good, "tiny", "", 0, ""), (3002, good, None, "", 0, "")]
    counts = Q.rule_counts(spark.createDataFrame(rows, SCHEMA))
    hosts = {r.host: r for r in Q.host_verdicts(counts).collect()}
    assert hosts["bad"].host_failed and not hosts["tiny"].host_failed
    assert hosts["tiny"].shrunk_rate < 0.5
    kept = {r.key: r.kept for r in Q.judge(counts, Q.host_verdicts(counts)).collect()}
    assert len(kept) == len(rows) and not kept[2000] and kept[3001] and kept[3002] and kept[0] and not kept[1000]


def test_empty_table(spark):
    counts = Q.rule_counts(spark.createDataFrame([], SCHEMA))
    assert Q.judge(counts, Q.host_verdicts(counts)).count() == 0
