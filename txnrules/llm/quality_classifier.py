"""Document quality from random-indexing word vectors and a two-layer numpy network.

Tokens are runs of letters, digits and non-ASCII characters, and runs of other marks; case is kept. A token's hash names one of 2**SLOT_BITS word slots, so that the table has
one size whatever the vocabulary, and rare words share slots (README: held-out figures by SLOT_BITS); each slot
has a fixed sparse index vector of NONZERO entries +1 or -1 in DIM dimensions. A slot's word vector is the sum, over all its
occurrences in all documents, of the index vectors of the tokens up to REACH places away. Every document adds to these sums:
each task adds up its own table and Spark sums the tables by slot, so what moves and what is broadcast have
a fixed size whatever the corpus. A document's vector is the mean and the spread of
its tokens' scaled word vectors. A network of one tanh layer and one output, trained with numpy on
at most TRAIN_ROWS labelled documents (those with the smallest hashes of their ids), gives a logit that a temperature, fitted on
a fifth of those rows kept apart, turns into a probability.

Nulls: a null text is an empty one; an empty text has a zero vector and a score like any other. Labels with a null id or null
quality teach nothing. Repeated rows are scored each; repeated labels count as often as they occur. Very long texts are read
whole. Ties in the order of labelled rows go by their ids. Other columns are not read. Without labels of both kinds every score is the labels' mean, or 0.5. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import table

SLOT_BITS, DIM, NONZERO, REACH = 16, 32, 4, 2
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-5
BYTES_AT_ONCE = 1_000_000
SPACE, MARK, WORD = 0, 1, 2
KIND = np.array([WORD if chr(b).isalnum() and b < 128 or b == 95 or b >= 128 else SPACE if b in b" \t\n\x0b\x0c\r" else MARK for b in range(256)], np.int8)
PLACES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
# What a byte adds to its token's hash, by the byte and its place in the token.
TERMS = np.where((KIND == SPACE)[:, None], np.uint64(0), (np.arange(256, dtype=np.uint64)[:, None] + np.uint64(1)) * PLACES).ravel()
AT_ONCE = 8192  # tokens whose vectors are pooled together, so that they stay in a core's cache


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every token of all texts, and the text it is in. A token is a run of word bytes or a run of marks."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[b]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    if kind[0] != SPACE:
        change = np.concatenate([[0], change])
    start = change[kind[change] != SPACE]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(b), dtype=np.uint32).astype(np.uint8)  # places count modulo 256
    place[start[0] :] -= np.repeat(start.astype(np.uint8), np.diff(start, append=len(b)))
    h = np.add.reduceat(TERMS[(b.astype(np.uint16) << 8) | place], start)
    h ^= h >> np.uint64(31)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    return ((h * SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), doc


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the nonzero entries of every slot's index vector; an entry's sign is the same in all slots."""
    rng = np.random.default_rng(20)
    columns = np.argsort(rng.random((1 << SLOT_BITS, DIM)), axis=1)[:, :NONZERO]
    signs = np.tile(np.array([1, -1] * (NONZERO // 2)), (1 << SLOT_BITS, 1))
    return columns, signs


def batches_of(texts: pa.Array):
    """(first text, texts as bytes) for runs of texts of about BYTES_AT_ONCE; a longer text is a run of its own."""
    start, taken, total = 0, [], 0
    for k, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        taken.append(t or b"")
        total += len(taken[-1])
        if total >= BYTES_AT_ONCE:
            yield start, taken
            start, taken, total = k + 1, [], 0
    if taken:
        yield start, taken


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A row of DIM per slot, summed over all documents; each row scaled to length 1, rows never seen are 0."""

    def run(batches):
        columns_of, signs_of = index_vectors()
        all_columns, signs = np.ascontiguousarray(columns_of.T), signs_of[0]
        rows = np.zeros((1 << SLOT_BITS, DIM))
        number = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, texts in batches_of(batch.column(0)):
                slot, doc = tokens(texts)
                used = np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS))
                number[used] = np.arange(len(used))
                slot, columns = number[slot], all_columns[:, used]
                here, there = [], []
                for d in range(1, REACH + 1):
                    both = doc[:-d] == doc[d:]
                    a, b = slot[:-d][both], slot[d:][both]
                    here += [a, b]
                    there += [b, a]
                here, there = np.concatenate(here) * DIM, np.concatenate(there)
                sums = np.zeros(len(used) * DIM, np.int64)
                for column, sign in zip(columns, signs, strict=True):
                    sums += sign * np.bincount(here + column[there], minlength=len(sums))
                rows[used] += sums.reshape(-1, DIM)
        some = np.flatnonzero(np.abs(rows).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(rows[some, k].astype(np.int64)) for k in range(DIM)]], ["slot", *[f"v{k}" for k in range(DIM)]])

    schema = "slot long, " + ", ".join(f"v{k} long" for k in range(DIM))
    summed = docs.select(text).mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)]).toArrow()
    out = np.zeros((1 << SLOT_BITS, DIM))
    out[summed["slot"].to_numpy()] = np.array([summed[f"v{k}"].to_numpy() for k in range(DIM)]).T
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text."""
    out = np.zeros((len(texts), 2 * vectors.shape[1]), np.float32)
    for start, taken in batches_of(texts):
        slot, doc = tokens(taken)
        if not len(slot):
            continue
        some, first, n = np.unique(doc, return_index=True, return_counts=True)
        ends, at = first + n, 0
        mean, squares = np.empty((2, len(some), vectors.shape[1]), np.float32)
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, first[at] + AT_ONCE, "right")))  # whole texts
            v = vectors[slot[first[at] : ends[to - 1]]]
            mean[at:to] = np.add.reduceat(v, first[at:to] - first[at], axis=0)
            v *= v
            squares[at:to] = np.add.reduceat(v, first[at:to] - first[at], axis=0)
            at = to
        n = n[:, None].astype(np.float32)
        mean /= n
        spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        out[start + some] = np.hstack([mean, spread])
    return out


class Network:
    """tanh layer, one output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray):
        """apart: rows that only the temperature is fitted on."""
        self.base = float(y.mean()) if len(y) else 0.5
        self.fitted = 0 < y[~apart].sum() < (~apart).sum() if len(y) else False
        self.temperature = 1.0
        if self.fitted:
            self.mean, self.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
            self._fit((x[~apart] - self.mean) / self.scale, y[~apart])
            if apart.any():
                z, t = self.logits(x[apart]), y[apart]
                grid = np.geomspace(0.2, 10, 60)
                losses = [np.mean(np.logaddexp(0, -np.where(t == 1, z, -z) / g)) for g in grid]
                self.temperature = float(grid[int(np.argmin(losses))])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(8)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                b = order[at : at + BATCH]
                h = np.tanh(x[b] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[b]) / len(b)
                back = np.outer(g, p[2]) * (1 - h * h)
                step += 1
                for k, d in enumerate((x[b].T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] * (1 - rate * DECAY) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most `rows` labelled documents."""
    hashed = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("h"))
    sample = hashed.orderBy("h", "id").limit(rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled(batch.column("text"), shared.value)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), lists], ["h", "y", "x"])

    of = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("text", "h", "y")
    got = of.mapInArrow(run, "h long, y double, x array<float>").orderBy("h", "y").limit(rows).toArrow()  # repeated ids count within the bound
    x = got["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(got), 2 * DIM)
    return Network(x, got["y"].to_numpy(), (got["h"].to_numpy() // 7) % 5 == 0)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of docs under `row`, with key and score."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    row = F.struct(*[F.col(c) for c in docs.columns])
    taken = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), row.alias("row"))

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            found = network.score(pooled(batch.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(found, pa.float64())], ["key", "row", "score"])

    return taken.mapInArrow(run, f"key long, row {taken.schema['row'].dataType.simpleString()}, score double")


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def learn(spark, sf_dir: str, docs: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from docs, and a network from the labels that are not held out."""
    vectors = word_vectors(docs)
    return vectors, train(docs, table(spark, sf_dir, "labels").filter(~held_out()), vectors)


def op8_random_indexing(spark, sf_dir: str) -> DataFrame:
    """All documents with a score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, *learn(spark, sf_dir, docs))
    return found.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
