"""Secrets in texts: three base rules, and formats learnt by grammar inference.

Base rules (leftmost, not overlapping within a kind): `assign`, a named value of six or more characters; `access`, AKIA and
capitals or digits, 20 or more; `hex`, 24 or more lower-case hex digits.

Learning: the credentials that the base rules found are the labelled ones, by kind; at most TRAIN distinct ones of each kind (those with
the smallest hashes, of at most LONGEST characters) are learnt from. A prefix tree of them is merged, red and blue states, into a probabilistic
automaton. Two states are compatible if three tests at level ALPHA don't tell them apart: likelihood-ratio tests of how many characters
follow and of the class (digit, small or capital letter, each mark, end) of the next one, and Hoeffding's bound on every next character; their
common followers that MIN_VISITS strings or more reach are tested likewise. States that a red state reaches by characters of one class are
tried with each other first, so that they are judged by all their strings. Of several compatible red states the one under which the blue
state's strings are likeliest is taken. So a format of one length stays a chain of positions, fixed prefixes stay, and random
bodies become one distribution per position or, where lengths vary, a loop.

A candidate is any maximal run of MIN_LENGTH or more credential characters that touches no base span. Every candidate is scored: its likelihood
under each kind's automaton, its end included, against a background of character pairs counted over all candidates of all
documents. One that beats the background by MARGIN per character, has a length that the kind's labelled credentials span, ends in a state where
some of them end, and is typical of the automaton, is a span of kind `format`. Typical: its likelihood per character, less what the states on its path expect, is at most SLACK below that of
nineteen in twenty labelled credentials that are kept apart from the fit (where there are fewer than 50, of all of them).

Texts are scanned twice, for the survey and for the spans; only labelled values and a table of character pairs of fixed size are shuffled.

Nulls: a null text has no spans; a null id is kept. Very long texts are read whole. Repeated rows are scanned each; a repeated credential is
learnt once. Ties between kinds don't matter: a span says only that it has a learnt format. A kind with fewer than
MIN_TRAIN credentials is not learnt. Other columns are not read. An empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import cut, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ALPHABET = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
SYMBOLS = len(ALPHABET)
END = SYMBOLS  # as a next symbol; as the one before, the start
CLASS = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3, 4, 5, 6, 7, 8] + [9])
CLASS_SIZE = np.bincount(CLASS)
OF_BYTE = np.full(256, -1, np.int16)
OF_BYTE[list(ALPHABET)] = np.arange(SYMBOLS)
MIN_LENGTH = 6
TRAIN, MIN_TRAIN, LONGEST = 1500, 10, 256
ALPHA, MIN_VISITS = 0.01, 8
MARGIN, SLACK = 0.5, 0.25  # per character
SHARED = 1000  # weight of a character's own frequency against its pairs, so that rare pairs do not explain themselves
BYTES_AT_ONCE = 2_000_000
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
SPANS_SQL = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: str) -> list[dict]:
    """Spans of the base rules, by start and kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found = [span("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [span("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [span("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=by_start)


def span(kind: str, start: int, end: int, value: str) -> dict:
    return {"kind": kind, "start": start, "end": end, "value": value}


def by_start(s: dict) -> tuple[int, int]:
    return s["start"], KINDS.index(s["kind"])


class Candidates:
    """All maximal runs of credential characters of several texts that touch no base span: `symbols` of all the texts, and per run its start, size and text."""

    def __init__(self, texts: list[bytes], base: list[list[dict]], decoded: list[str]):
        joined = b"\n".join(texts) + b"\n"
        self.symbols = OF_BYTE[np.frombuffer(joined, np.uint8)]
        self.begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        edge = np.flatnonzero(np.diff(self.symbols >= 0, prepend=False))
        start, size = edge[::2], edge[1::2] - edge[::2]
        long = size >= MIN_LENGTH
        start, size = start[long], size[long]
        if any(base):
            touched = np.zeros(len(joined) + 1, np.int32)
            for k, spans in enumerate(base):
                for s in spans:
                    at = self.begin[k] + (s["start"] if len(texts[k]) == len(decoded[k]) else len(decoded[k][: s["start"]].encode()))
                    touched[at + 1 : at + 1 + len(decoded[k][s["start"] : s["end"]].encode())] = 1
            touched = np.cumsum(touched)
            free = touched[start + size] == touched[start]
            start, size = start[free], size[free]
        self.start, self.size = start, size
        self.text = np.searchsorted(self.begin, start, "right") - 1

    def pairs(self) -> np.ndarray:
        """Counts of (symbol before, symbol) over all runs; starts and ends count as symbols."""
        if not len(self.start):
            return np.zeros((SYMBOLS + 1) ** 2, np.int64)
        inside = np.repeat(self.start - np.cumsum(self.size) + self.size, self.size) + np.arange(self.size.sum())
        now = self.symbols[inside].astype(np.int64)
        before = np.where(np.isin(inside, self.start, assume_unique=True), END, self.symbols[inside - 1]).astype(np.int64)
        last = self.symbols[self.start + self.size - 1].astype(np.int64)
        return np.bincount(before * (SYMBOLS + 1) + now, minlength=(SYMBOLS + 1) ** 2) + np.bincount(last * (SYMBOLS + 1) + END, minlength=(SYMBOLS + 1) ** 2)


def chi_square(df: int, z: float = 2.326) -> float:
    """Upper quantile of chi-square by Wilson and Hilferty; z is the normal quantile of ALPHA."""
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def ratio_differs(a: Counter, b: Counter) -> bool:
    """Likelihood-ratio test that two tables of counts come from different distributions."""
    n1, n2 = sum(a.values()), sum(b.values())
    cells = a.keys() | b.keys()
    if len(cells) < 2:
        return False
    g = 0.0
    for k in cells:
        x, y = a.get(k, 0), b.get(k, 0)
        p = (x + y) / (n1 + n2)
        g += (x * math.log(x / (n1 * p)) if x else 0.0) + (y * math.log(y / (n2 * p)) if y else 0.0)
    return 2 * g > chi_square(len(cells) - 1)


class Automaton:
    """Deterministic probabilistic automaton from a sample of strings, by merging the states of their prefix tree."""

    def __init__(self, strings: list[str]):
        self.bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        self.arcs: list[dict[int, list[int]]] = [{}]  # symbol -> [target, count]
        self.rest: list[Counter] = [Counter()]  # how many characters follow, with the number of strings
        self.depth = [0]
        for s in strings:
            self._add(OF_BYTE[np.frombuffer(s.encode(), np.uint8)].tolist())
        red = [0]
        while blue := {t for r in red for t, _ in self.arcs[r].values()} - set(red):
            b = min(blue, key=lambda q: (self.depth[q], -self.visits(q), q))
            self._pool(red, blue, b)
            fits = [(self._fit(r, b), -r) for r in red if self._compatible(r, b)]
            if fits:
                r = -max(fits)[1]
                self._redirect(red, b, r)
                self._fold(r, b)
            else:
                red.append(b)
        self._tabulate(red)

    def visits(self, q: int) -> int:
        return self.rest[q].total()

    def _add(self, symbols: list[int]) -> None:
        q, left = 0, len(symbols)
        self.rest[0][left] += 1
        for c in symbols:
            left -= 1
            if c not in self.arcs[q]:
                self.arcs.append({})
                self.rest.append(Counter())
                self.depth.append(self.depth[q] + 1)
                self.arcs[q][c] = [len(self.arcs) - 1, 0]
            arc = self.arcs[q][c]
            arc[1] += 1
            q = arc[0]
            self.rest[q][left] += 1

    def _classes(self, q: int) -> Counter:
        found = Counter()
        for c, (_, n) in self.arcs[q].items():
            found[int(CLASS[c])] += n
        if self.rest[q][0]:
            found[int(CLASS[END])] = self.rest[q][0]
        return found

    def _compatible(self, a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            if ratio_differs(self.rest[a], self.rest[b]) or ratio_differs(self._classes(a), self._classes(b)):
                return False
            n1, n2 = self.visits(a), self.visits(b)
            limit = self.bound * (n1**-0.5 + n2**-0.5)
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                x, y = self.arcs[a].get(c), self.arcs[b].get(c)
                if abs((x[1] if x else 0) / n1 - (y[1] if y else 0) / n2) > limit:
                    return False
                if x and y and min(x[1], y[1]) >= MIN_VISITS:
                    stack.append((x[0], y[0]))
        return True

    def _pool(self, red: list[int], blue: set[int], b: int) -> None:
        """Merges into b the states beside it, reached by a character of the same class, that are compatible with it: together they tell more."""
        for r in red:
            mine = {int(CLASS[c]) for c, (t, _) in self.arcs[r].items() if t == b}
            for c, (t, _) in list(self.arcs[r].items()):
                if int(CLASS[c]) in mine and t != b and t in blue and self._compatible(b, t):
                    self._redirect(red, t, b)
                    self._fold(b, t)

    def _fit(self, r: int, b: int) -> float:
        """Log-likelihood of what follows b (lengths and next classes) under r."""
        total = 0.0
        for own, other in ((self.rest[r], self.rest[b]), (self._classes(r), self._classes(b))):
            n = sum(own.values())
            total += sum(k * math.log((own.get(x, 0) + 0.1) / (n + 1)) for x, k in other.items())
        return total

    def _redirect(self, red: list[int], old: int, new: int) -> None:
        for r in red:
            for arc in self.arcs[r].values():
                if arc[0] == old:
                    arc[0] = new

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.rest[a].update(self.rest[b])
            for c, (t, n) in self.arcs[b].items():
                arc = self.arcs[a].get(c)
                if arc is None:
                    self.arcs[a][c] = [t, n]
                else:
                    arc[1] += n
                    stack.append((arc[0], t))

    def _tabulate(self, red: list[int]) -> None:
        """Tables of log-probabilities (the end last) and targets. A state shares a part of its mass between the symbols of a class, by the class's frequency;
        an unseen symbol leads where most of its class, or else most of all, lead. The last state is a sink for what comes after certain ends."""
        place = {q: k for k, q in enumerate(red)}
        self.states, sink = len(red), len(red)
        self.log_p = np.full((sink + 1, SYMBOLS + 1), -math.log(SYMBOLS) - 10)
        self.target, self.final = np.full((sink + 1, SYMBOLS), sink, np.int32), np.zeros(sink + 1, bool)
        for q, k in place.items():
            own, classes, n = np.zeros(SYMBOLS + 1), np.full(10, 0.1), self.visits(q)
            own[END], self.final[k] = self.rest[q][0], self.rest[q][0] > 0
            heirs: dict[int, Counter] = {}
            for c, (t, m) in self.arcs[q].items():
                own[c] = m
                for x in (int(CLASS[c]), -1):
                    heirs.setdefault(x, Counter())[place[t]] += m
            np.add.at(classes, CLASS, own)
            shared = (classes / classes.sum() / CLASS_SIZE)[CLASS]
            self.log_p[k] = np.log((own + 2 * shared) / (n + 2))
            for c in range(SYMBOLS):
                if c in self.arcs[q]:
                    self.target[k, c] = place[self.arcs[q][c][0]]
                elif of := heirs.get(int(CLASS[c])) or heirs.get(-1):
                    self.target[k, c] = max(of, key=lambda t: (of[t], -t))
        self.expected = (np.exp(self.log_p) * self.log_p).sum(axis=1)
        del self.arcs, self.rest, self.depth  # scoring needs the tables only, so the tree is not shipped

    def score(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per run of symbols, its end included: the log-likelihood, and by how much that exceeds what the states on its path expect; -inf if it ends
        in a state where no labelled credential ended.

        All runs walk together, a symbol at a time.
        """
        total, expected, state, left = np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start), np.int64), np.arange(len(start))
        for step in range(int(size.max(initial=0))):
            left = left[size[left] > step]
            c = symbols[start[left] + step]
            total[left] += self.log_p[state[left], c]
            expected[left] += self.expected[state[left]]
            state[left] = self.target[state[left], c]
        total += self.log_p[state, END]
        return total, np.where(self.final[state], total - expected - self.expected[state], -np.inf)

    def score_texts(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in strings], np.int64)
        return self.score(OF_BYTE[np.frombuffer("".join(strings).encode(), np.uint8)], np.cumsum(sizes) - sizes, sizes)


class Formats:
    """One automaton per kind, with its lengths and least likelihood, and the background."""

    def __init__(self, labelled: dict[str, list[str]], pairs: np.ndarray):
        counts = pairs.reshape(SYMBOLS + 1, SYMBOLS + 1)
        single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * (SYMBOLS + 1))
        self.background = np.log((counts + SHARED * single) / (counts.sum(axis=1, keepdims=True) + SHARED))
        self.kinds: dict[str, tuple[Automaton, int, int, float]] = {}
        for kind, values in labelled.items():
            if len(values) >= MIN_TRAIN:
                apart = values[::5] if len(values) >= 5 * MIN_TRAIN else values
                automaton = Automaton([v for k, v in enumerate(values) if k % 5] if apart is not values else values)
                excess = automaton.score_texts(apart)[1] / [len(v) for v in apart]
                excess = np.sort(excess[np.isfinite(excess)])
                if not len(excess):
                    continue
                self.kinds[kind] = automaton, min(map(len, values)), max(map(len, values)), float(excess[len(excess) // 20]) - SLACK

    def accepted(self, found: Candidates, margin: float = MARGIN) -> np.ndarray:
        """Indexes of the candidates that have a learnt format."""
        good = np.zeros(len(found.start), bool)
        for automaton, least, most, typical in self.kinds.values():
            at = np.flatnonzero((found.size >= least) & (found.size <= most) & ~good)
            if not len(at):
                continue
            start, size = found.start[at], found.size[at]
            own, excess = automaton.score(found.symbols, start, size)
            some = np.flatnonzero(excess >= typical * size)
            other = self._background(found.symbols, start[some], size[some])
            good[at[some[own[some] - other > margin * size[some]]]] = True
        return np.flatnonzero(good)

    def _background(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total, before, left = np.zeros(len(start)), np.full(len(start), END), np.arange(len(start))
        for step in range(int(size.max(initial=0))):
            left = left[size[left] > step]
            c = symbols[start[left] + step]
            total[left] += self.background[before[left], c]
            before[left] = c
        return total + self.background[before, END]


def pieces(texts: list[str | None]):
    """(texts, their UTF-8, their base spans) of about BYTES_AT_ONCE; a longer text is a piece of its own."""
    taken, spelled, total = [], [], 0
    for k, t in enumerate(texts):
        taken.append(t or "")
        spelled.append(taken[-1].encode())
        total += len(spelled[-1])
        if total >= BYTES_AT_ONCE or k == len(texts) - 1:
            yield taken, spelled, [base_spans(x) for x in taken]
            taken, spelled, total = [], [], 0


def survey(docs: DataFrame, text: str = "text") -> DataFrame:
    """Written table: (kind, value) of every labelled credential, and, with kind null, each task's counts n of the pairs of neighbouring characters in candidates."""

    def run(batches):
        pairs = np.zeros((SYMBOLS + 1) ** 2, np.int64)
        for batch in batches:
            told = set()
            for texts, spelled, base in pieces(batch.column(0).to_pylist()):
                pairs += Candidates(spelled, base, texts).pairs()
                told |= {(s["kind"], s["value"]) for spans in base for s in spans if len(s["value"]) <= LONGEST}
            told, none = sorted(told), pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.string()), pa.array([v for _, v in told], pa.string()), none, none], ["kind", "value", "pair", "n"])
        some = np.flatnonzero(pairs)
        none = pa.nulls(len(some), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(some), pa.array(pairs[some])], ["kind", "value", "pair", "n"])

    return cut(docs.select(text).mapInArrow(run, "kind string, value string, pair long, n long"))


def learn(surveyed: DataFrame, train: int = TRAIN) -> Formats:
    """Automata from bounded samples of distinct labelled values; the background counts every candidate."""
    values = surveyed.filter("kind IS NOT NULL").select("kind", "value").distinct().withColumn("h", F.xxhash64("value"))
    sample = {k: [r.value for r in values.filter(F.col("kind") == k).orderBy("h", "value").limit(train).collect()] for k in KINDS[:3]}
    pairs = np.zeros((SYMBOLS + 1) ** 2)
    for r in surveyed.filter("kind IS NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    return Formats(sample, pairs)


def scan(docs: DataFrame, formats: Formats, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """key and all spans, by start and kind, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches):
        for batch in batches:
            out = []
            for texts, spelled, base in pieces(batch.column(1).to_pylist()):
                found = Candidates(spelled, base, texts)
                for k in shared.value.accepted(found, margin).tolist():
                    of = int(found.text[k])
                    at = int(found.start[k] - found.begin[of])
                    value = spelled[of][at : at + int(found.size[k])].decode()
                    at = len(spelled[of][:at].decode())
                    base[of].append(span("format", at, at + len(value), value))
                out += [sorted(spans, key=by_start) for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], ["key", "spans"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key long, spans {SPANS_SQL}")


def told(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_grammar_inference(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn(survey(docs)))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("key").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(told(of("assign", "access", "hex")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
