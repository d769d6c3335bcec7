"""Buckets of shared band hashes, block pairs within groups, and connected components, as Spark jobs.

A bucket is the set of nodes that share a band hash; bands with the same members are one bucket, and bands of one node are none. A
bucket (or another group) goes to one task if it is small; a large one is cut into blocks by hash, and each pair of blocks is a task, so no
task holds more than two blocks, and pairs are compared where they are and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import cut
from txnrules.llm.shingles import mixed

BLOCK_ROWS, BLOCK_BYTES = 1024, 8_000_000
MAX_ROUNDS = 60
GROUP_ROWS = 2000
KNOWN = 1_000_000  # nodes that a task remembers having told
PART_ROWS, PACKED_ROWS, MOST_HELD, LARGE = 1_000_000, 1_000_000, 8_000_000, 4096
MOST_BITS = 30  # of a bitmap of marks: 128 MB


class Fresh:
    """Nodes that a task sees for the first time; forgets when full, so that a node may come again."""

    def __init__(self):
        self.known: set[int] = set()

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """Indexes of nodes not known before, each once."""
        nodes, first = np.unique(nodes, return_index=True)
        fresh = [i for i, x in zip(first.tolist(), nodes.tolist(), strict=True) if x not in self.known]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known.update(nodes.tolist())
        return np.array(fresh, np.int64)


def parts_of(spark, rows: int) -> int:
    """Number of parts that band hashes are dealt into, of about PART_ROWS rows each, and a few for every task."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS)


class Packer:
    """Band hashes of one task, dealt into parts: a row (part, bands, nodes) packs many of them, so that a shuffle moves 12 bytes a band."""

    def __init__(self, parts: int):
        self.parts, self.held, self.rows = parts, [], 0

    def add(self, bands: np.ndarray, nodes: np.ndarray):
        """bands: hashes, a row per node. Yields what is full."""
        self.held.append((bands.view(np.uint64).ravel(), np.repeat(nodes, bands.shape[1])))
        self.rows += bands.size
        if self.rows >= PACKED_ROWS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        band = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in self.held)])
        node = np.concatenate([np.zeros(0, np.int64), *(x for _, x in self.held)])
        part = ((band >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, band, node = part[order], band[order].astype(np.uint32), node[order]
        some, first = np.unique(part, return_index=True)
        ends = np.append(first[1:], len(part))[: len(first)].tolist()
        packed = [[x[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)] for x in (band, node)]
        self.held, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x, pa.binary()) for x in packed]], ["part", "bands", "nodes"])


PACKED = "part long, bands binary, nodes binary"


def buckets(packed: DataFrame) -> DataFrame:
    """Written table (root, node): the members of every bucket of the rows of Packers, in which a band of a node may repeat; root names the bucket.

    A task sorts a part at a time. Of a band that very many nodes have only the nodes that came last are held: the others are told at once.
    """

    def run(batches):
        now, large, held, rows = None, set(), [], 0
        for batch in batches:
            for part, band, node in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != now:
                    yield from told(now, held, large)
                    now, large, held, rows = part, set(), [], 0
                held.append((np.frombuffer(band, np.uint32), np.frombuffer(node, np.int64)))
                rows += len(held[-1][0])
                if rows >= MOST_HELD:
                    left = []
                    yield from told(now, held, large, left)
                    held, rows = left, len(left[0][0])
                    if rows >= MOST_HELD // 2:  # a part without large bands: hold on
                        rows = 0
        yield from told(now, held, large)

    def told(part, held, large, left=None):
        """Buckets of the rows held; with `left`, only those of large bands, and what has to stay goes into left."""
        if not held:
            return
        band, node = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.lexsort((node, band))
        band, node = band[order], node[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (node[1:] != node[:-1])
        band, node = band[new], node[new]
        first = np.flatnonzero(np.diff(band, prepend=band[:1] + np.uint32(1)))
        sizes = np.diff(np.append(first, len(band)))
        big = sizes > LARGE
        if large:
            big |= np.isin(band[first], np.fromiter(large, np.uint32, len(large)))
        sums = np.add.reduceat(mixed(node.view(np.uint64)), first)
        root = mixed(np.where(big, band[first].astype(np.uint64) | np.uint64(part << 32 & 0xFFFFFFFF00000000), sums ^ mixed(sums + sizes.astype(np.uint64)))).view(np.int64)
        tell = big if left is not None else big | (sizes > 1)
        rows = np.repeat(tell, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(root, sizes)[rows]), pa.array(node[rows])], ["root", "node"])
        if left is not None:
            large.update(band[first[big]].tolist())
            stay = ~rows
            stay[first[big]] = True
            left.append((band[stay], node[stay]))

    dealt = packed.repartition("part").sortWithinPartitions("part")
    return cut(dealt.mapInArrow(run, "root long, node long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Alternates joining each node's larger neighbours to its least one and each node to the least of its smaller ones,
    until nothing changes. Each round is written to the shared folder.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every edge now points down; joined to the least lower neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u > v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def in_blocks(rows: DataFrame, groups: DataFrame, process: Callable[..., Iterator[pa.RecordBatch]], schema: str, size: str) -> DataFrame:
    """rows (with node, and what else process needs; `size` is a column of bytes) joined to groups (node, root), one group per pair of blocks.

    process gets (table, starts, left): rows of one or more whole groups, where each group starts, and for each row whether it is of its
    group's first block; for a single block all are. Of two blocks both have rows: a pair with an empty block is left out, as the other block
    is compared with itself in its own task. Small groups come together, about GROUP_ROWS rows at a time.
    """
    member = rows.join(groups, "node")
    totals = rows.select("node", size).join(groups, "node").groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks")).filter("blocks > 1")
    cutup = member.join(totals, "root", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        cutup.withColumn("mine", F.coalesce(mine, F.lit(0)))
        .withColumn("other", F.explode(others))
        .withColumn("first", F.least("mine", "other"))
        .withColumn("second", F.greatest("mine", "other"))
        .drop("other", "blocks")
        .repartition("root", "first", "second")
        .sortWithinPartitions("root", "first", "second", "node")
    )

    def run(batches):
        held: list[pa.RecordBatch] = []  # whole groups, and the rows so far of the last one
        rows, starts, key = 0, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array([batch.column(c).to_numpy() for c in ("root", "first", "second")])
            cuts = np.flatnonzero((np.diff(ids) != 0).any(axis=0)) + 1
            new = ([0] if tuple(ids[:, 0].tolist()) != key else []) + cuts.tolist()
            key, done = tuple(ids[:, -1].tolist()), 0
            for at in new:
                if rows + at - done >= GROUP_ROWS:
                    held.append(batch.slice(done, at - done))
                    yield from whole(held, starts)
                    held, rows, starts, done = [], 0, [], at
                starts.append(rows + at - done)
            held.append(batch.slice(done))
            rows += batch.num_rows - done
        if rows:
            yield from whole(held, starts)

    def whole(held, starts):
        table = pa.Table.from_batches(held)
        first = table["first"].to_numpy()
        left, single = table["mine"].to_numpy() == first, first == table["second"].to_numpy()
        sizes = np.diff(np.append(starts, len(left)))
        ours = np.add.reduceat(left.astype(np.int64), starts)
        good = single[starts] | ((ours > 0) & (ours < sizes))
        if not good.all():
            rows, sizes = np.flatnonzero(np.repeat(good, sizes)), sizes[good]
            table, left, starts = table.take(pa.array(rows)), left[rows], (np.cumsum(sizes) - sizes).tolist()
        if starts:
            yield from process(table, starts, left)

    return dealt.mapInArrow(run, schema)


class Marks:
    """A bitmap over hashed nodes. A marked node always tests true; others seldom while the bitmap is sparse."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def test(self, nodes: np.ndarray) -> np.ndarray:
        bit = _bit(nodes, self.bits)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _bit(nodes: np.ndarray, bits: int) -> np.ndarray:
    return (nodes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def marks(nodes: DataFrame):
    """Broadcast Marks of the column node of a written table: 16 to 32 bits a node, at most 2**MOST_BITS. It only spares rows a shuffle, a join still
    decides: beyond some 10**8 nodes more rows than needed are shuffled."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * nodes.count() + 1))))

    def run(batches):
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "bits"])

    told = nodes.select("node").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[told["word"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
    return nodes.sparkSession.sparkContext.broadcast(Marks(words, bits))


def marked(rows: DataFrame, shared, column: str = "node") -> DataFrame:
    """rows whose node is marked; only that column goes through Python."""

    @F.pandas_udf("boolean")
    def test(nodes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.test(nodes.to_numpy()))

    return rows.filter(test(column))


def block_pairs(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs between the two blocks, or within a single one."""
    if left.all():
        return np.triu_indices(len(left), 1)
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new
