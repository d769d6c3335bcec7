"""Similarity join of documents on word shingles, with Bayesian pruning of candidates.

Documents with the same words are one text; each different text gets one set of WORDS-word shingles and a MinHash signature.
Texts that share a band of the signature are candidates. For each candidate pair the MinHash values are compared a chunk at a
time; with a uniform prior, the chance that the similarity reaches OVER / UNDER given m equal values out of n is a tail of
Beta(m + 1, n - m + 1), and a pair is dropped as soon as that falls below TOLERANCE. The remaining pairs are verified
exactly. 32 bands of 4 values miss a pair of similarity 0.8 with a chance below 1e-7.

That is done twice: bucket by bucket on signatures alone, where the pairs that aren't dropped only join their texts into candidate groups, and
then within these groups, where texts are at hand, pair by pair. Chance bands between unlike texts so never chain groups together.

Per document: class_id (the same for documents joined by a chain of links), first_doc_id (least id in the class), n_links (documents of a similarity
of at least 0.8, copies included, itself not). Links are counted inside the tasks and only sums and stars leave them,
so no list of pairs is ever made; nothing is capped. The working copy of the texts in the shared folder is about the size of the input.

Nulls: a text that is null or has no word has no links and a class of its own; `first_of_each` takes texts without words that are equal but for
white space for copies of each other, and keeps every null. A text of fewer than WORDS words is one shingle of all its
words. Null and repeated ids are kept as they are: rows count, not ids. Repeated rows are copies. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm import shingles as S
from txnrules.llm.groups import PACKED, Fresh, Packer, block_pairs, buckets, components, in_blocks, local_roots, marked, marks, parts_of
from txnrules.llm.runtime import cut, table, union_all

VALUES, ROWS, CHUNK = 128, 4, 16
OVER, UNDER = 4, 5  # similarity of at least 0.8
TOLERANCE = 1e-6
PAIRS_AT_ONCE = 100_000
FEW = 32  # rows of a bucket whose pairs are compared together with those of others


def least_equal(over: int, under: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values, the least m equal ones with a posterior chance of at least `tolerance` to reach over / under."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = {}
    for n in range(CHUNK, VALUES + 1, CHUNK):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= over / under].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Written table, a row per document: rid, row (key, text and the columns of carry), digest of the words (null without words), half (its first 64 bits), sig, blank (digest of a text without words)."""
    row = F.struct(*[F.col(c) for c in dict.fromkeys([key, text, *carry])])
    taken = docs.select(F.col(text).alias("text"), row.alias("row"))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words = [S.normal_words(t) for t in texts]
            for a, b in S.runs(words):
                part = words[a:b]
                sig = S.signatures(*S.word_shingles(part), VALUES)
                digests = [S.digest(w) if w else None for w in part]
                half = pa.array([None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                made = [pa.array(digests, pa.binary()), half, pa.array([x.tobytes() for x in sig], pa.binary())]
                blank = pa.array([None if w or t is None else S.digest(b" ".join(t.encode().split())) for w, t in zip(part, texts[a:b], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*made, blank, batch.column(1).slice(a, b - a)], ["digest", "half", "sig", "blank", "row"])

    made = taken.mapInArrow(run, f"digest binary, half long, sig binary, blank binary, row {taken.schema['row'].dataType.simpleString()}")
    stored = cut(made.select(F.monotonically_increasing_id().alias("rid"), "*"))
    return stored.select("rid", F.col("row")[key].cast("long").alias("key"), F.col("row")[text].alias("text"), "digest", "half", "sig", "blank", "row")


def _bands(rows: DataFrame, texts: int) -> DataFrame:
    """Packed bands of every text, once a task; nodes are halves of digests."""
    parts = parts_of(rows.sparkSession, texts * (VALUES // ROWS))

    def run(batches):
        fresh, packer = Fresh(), Packer(parts)
        for batch in batches:
            node = batch.column(0).to_numpy()
            at = fresh.of(node)
            yield from packer.add(S.band_hashes(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)[at], ROWS), node[at])
        yield packer.flush()

    return rows.filter("half IS NOT NULL").select("half", "sig").mapInArrow(run, PACKED)


def _prune(over: int, under: int):
    """Buckets of rows with node and sig: joins the rows that pruning leaves in a pair, as (node, root)."""
    limits = least_equal(over, under)

    def process(table: pa.Table, starts: list[int], left: np.ndarray):
        node = table["node"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(starts, [*starts[1:], len(left)], strict=True):
            if hi - lo <= FEW:
                x, y = block_pairs(left[lo:hi])
                a.append(lo + x)
                b.append(lo + y)
            else:
                x, y = spanning(sig[lo:hi], left[lo:hi], limits)
                a.append(lo + x)
                b.append(lo + y)
        a, b = np.concatenate(a), np.concatenate(b)
        kept = [k[similar(sig, a[k], b[k], limits)] for k in (np.arange(at, min(at + PAIRS_AT_ONCE, len(a))) for at in range(0, len(a), PAIRS_AT_ONCE))]
        kept = np.concatenate([np.zeros(0, np.int64), *kept])
        root = local_roots(len(node), a[kept], b[kept])
        other = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], ["node", "root"])

    return process


def spanning(sig: np.ndarray, left: np.ndarray, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no chunk drops and that join whatever all such pairs of a large bucket join: a row is compared only with rows it isn't joined with."""
    root = np.arange(len(sig))
    others = np.ones(len(sig), bool) if left.all() else ~left
    a, b = [], []
    for i in np.flatnonzero(left).tolist():
        rest = np.flatnonzero(others & (root != root[i]))
        mine = np.full(len(rest), i)
        good = rest[similar(sig, mine, rest, limits)]
        if len(good):
            joined = np.append(root[good], root[i])
            root[np.isin(root, joined)] = joined.min()
            a.append(np.full(len(good), i))
            b.append(good)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verify(over: int, under: int):
    limits = least_equal(over, under)

    def process(table: pa.Table, starts: list[int], left: np.ndarray):
        for a, b in zip(starts, [*starts[1:], len(left)], strict=True):
            if b - a > 1:
                yield from one(table.slice(a, b - a), left[a:b])

    def one(t: pa.Table, left: np.ndarray):
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
        bands = S.band_hashes(sig, ROWS)
        sets = S.split_sets(*S.word_shingles([S.normal_words(x) for x in t["text"].to_pylist()]))
        a, b = candidates(bands, left)
        kept = [k[similar(sig, x, y, limits)] for k, x, y in ((np.arange(at, min(at + PAIRS_AT_ONCE, len(a))), a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]) for at in range(0, len(a), PAIRS_AT_ONCE))]
        kept = np.concatenate(kept) if kept else np.zeros(0, int)
        a, b = a[kept], b[kept]
        good = S.similar_pairs(sets, a, b, over, under)
        a, b = a[good], b[good]
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        root = node[local_roots(len(node), a, b)]
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["node", "links", "root"])

    return process


def candidates(bands: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair that share a band."""
    if len(bands) <= 64:
        a, b = block_pairs(left)
        share = (bands[a] == bands[b]).any(axis=1)
        return a[share], b[share]
    rows = np.flatnonzero(left)
    cols = rows if left.all() else np.flatnonzero(~left)
    share = np.zeros((len(rows), len(cols)), bool)
    for k in range(bands.shape[1]):
        share |= bands[rows, k, None] == bands[None, cols, k]
    if left.all():
        share = np.triu(share, 1)
    i, j = np.nonzero(share)
    return rows[i], cols[j]


def similar(sig: np.ndarray, a: np.ndarray, b: np.ndarray, limits: dict[int, int]) -> np.ndarray:
    """Indexes of the pairs that no chunk of values drops."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, least in limits.items():
        equal = equal + (sig[a[alive], n - CHUNK : n] == sig[b[alive], n - CHUNK : n]).sum(axis=1, dtype=np.int32)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
    return alive


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", over: int = OVER, under: int = UNDER) -> DataFrame:
    """rid, key, class_id, first_doc_id, n_links, is_first (one row of each class) per document."""
    return _joined(prepared(docs, key, text).drop("row", "blank"), over, under)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", over: int = OVER, under: int = UNDER) -> DataFrame:
    """docs with one row of each class, and of each group of equal texts without words, the one with the least id; same columns."""
    rows = prepared(docs, key, text, tuple(docs.columns))
    chosen = _joined(rows.filter("digest IS NOT NULL").drop("row", "blank"), over, under).filter("is_first").select("rid")
    wordless = rows.filter("blank IS NOT NULL").groupBy("blank").agg(F.min(F.struct(F.col("key").isNull(), "key", "rid")).getField("rid").alias("rid")).select("rid")
    chosen = union_all([chosen, wordless, rows.filter("digest IS NULL AND blank IS NULL").select("rid")])
    return rows.select("rid", "row").join(chosen, "rid", "left_semi").select("row.*").select(*docs.columns)


def _joined(rows: DataFrame, over: int, under: int) -> DataFrame:
    texts = cut(rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("rid").alias("node"), F.min("half").alias("half"), F.count("*").alias("copies")))
    bucketed = cut(buckets(_bands(rows, texts.count())).withColumnRenamed("node", "half").join(texts.select("half", "node", "copies"), "half").select("root", "node", "copies"))
    own = cut(marked(rows.withColumnRenamed("rid", "node").select("node", "sig", "text"), marks(bucketed)).withColumn("bytes", F.octet_length("text") + 600))
    pruned = in_blocks(own.select("node", "sig", F.lit(600).alias("bytes")), bucketed.select("root", "node"), _prune(over, under), "node long, root long", "bytes")
    candidates = cut(components(pruned).join(bucketed.select("node", "copies").distinct(), "node"))
    found = cut(in_blocks(own, candidates, _verify(over, under), "node long, links long, root long", "bytes"))
    linked = components(found.select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    # The small sides of both joins are written first, so that hot texts and classes of the large side can be split between tasks.
    of_text = cut(
        texts.join(linked, "node", "left")
        .join(counts, "node", "left")
        .select("digest", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    narrow = rows.select("rid", "key", "digest")
    placed = cut(narrow.join(of_text, "digest", "left").select("rid", "key", F.coalesce("class_id", "rid").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    first = F.min(F.struct(F.col("key").isNull(), "key", "rid")).getField("rid").alias("first_rid")
    several = cut(placed.groupBy("class_id").agg(F.min("key").alias("first"), first, F.count("*").alias("n")).filter("n > 1").drop("n"))
    alone = F.col("first_rid").isNull()
    return placed.join(several, "class_id", "left").select(
        "rid", "key", "class_id", F.when(alone, F.col("key")).otherwise(F.col("first")).alias("first_doc_id"), "n_links", (alone | (F.col("rid") == F.col("first_rid"))).alias("is_first")
    )


def op5_bayesian_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents with their class and number of links."""
    found = join(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "first_doc_id", "n_links")
