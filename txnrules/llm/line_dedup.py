"""Fuzzy line deduplication across documents.

Lines are the \\n-separated parts of the texts; compared is their normal form: ASCII letters lower-cased, runs of white space one
space, ends trimmed. A line's set is its shingles of CHARS characters (a shorter line is one shingle). MinHash signatures of BANDS bands of
ROWS values find candidates (a pair of similarity 0.8 is missed with a chance of 3e-5, one of 0.9 with 1e-9), exact Jaccard
similarity of at least OVER / UNDER verifies them bucket by bucket, and distributed union-find joins verified pairs into components. Of each
component the first line stays: first by document id, then by place in the document; all other lines of the component go, equal ones
included. Lines without a letter, digit or other visible character are kept where they are and belong to no component.

Buckets of at most SMALL lines are verified together. A task that verifies a larger one compares its lines only until they are one component, so buckets of thousands of
variants cost little more than one comparison each. Lines are known by 64-bit hashes of their normal forms, and shingles by 64-bit hashes; only the
lines that have a candidate are shuffled with their text, each once.

Nulls: a null text has no lines and stays null; an empty text has one empty line. Null ids sort last. Ties: of lines of one document id the
one earlier in the input is the first. Repeated ids and repeated rows are
documents of their own: ids name documents in the result, rows are told apart by their place in the input. Very long texts
and lines are read whole. Columns other than id and text pass through `dedup` untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from txnrules.llm import shingles as S
from txnrules.llm.groups import PACKED, Fresh, Packer, buckets, components, in_blocks, marks, parts_of
from txnrules.llm.runtime import cut, table

ROWS, BANDS = 4, 20
VALUES = ROWS * BANDS
OVER, UNDER = 4, 5
SMALL = 64  # lines of a bucket that is compared together with others
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(line: bytes) -> bytes:
    return b" ".join(line.translate(LOWER).split())


def numbers(lines: list[bytes]) -> np.ndarray:
    """The nodes of normal forms."""
    return np.fromiter(map(xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Written table, a row per document that has a text: rid, key, per line its node (null if blank), and the number of lines n."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in S.runs(texts):
                lines = [normal(x) for t in texts[a:b] for x in t.split(b"\n")]
                blank = ~np.fromiter(map(bool, lines), bool, len(lines))
                many = np.array([t.count(b"\n") + 1 for t in texts[a:b]])
                nodes = pa.ListArray.from_arrays(np.cumsum([0, *many]).astype(np.int32), pa.array(numbers(lines), mask=blank))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), nodes, pa.array(many)], ["rid", "key", "nodes", "n"])

    return cut(docs.filter(F.col(text).isNotNull()).select("rid", F.col(key).cast("long").alias("key"), text).mapInArrow(run, "rid long, key long, nodes array<long>, n long"))


def _new_lines(batch: pa.RecordBatch, wanted):
    """(lines, nodes) of the texts in the first column, those for which `wanted` (nodes to indexes) asks, a piece of the batch at a time."""
    texts = batch.column(0).cast(pa.binary()).to_pylist()
    for a, b in S.runs(texts):
        lines = [n for t in texts[a:b] for x in t.split(b"\n") if (n := normal(x))]
        node = numbers(lines)
        at = wanted(node)
        yield [lines[k] for k in at.tolist()], node[at]


def _bands(docs: DataFrame, text: str, lines: int) -> DataFrame:
    """Packed bands of every line, once a task."""
    parts = parts_of(docs.sparkSession, lines * BANDS)

    def run(batches):
        fresh, packer = Fresh(), Packer(parts)
        for batch in batches:
            for new, node in _new_lines(batch, fresh.of):
                yield from packer.add(S.band_hashes(S.signatures(*S.char_shingles(new), VALUES), ROWS), node)
        yield packer.flush()

    return docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, PACKED)


def _texts(docs: DataFrame, text: str, shared) -> DataFrame:
    """Written table (node, line, bytes) of the lines whose node is marked, each once."""

    def run(batches):
        fresh = Fresh()

        def wanted(node):
            at = np.flatnonzero(shared.value.test(node))
            return at[fresh.of(node[at])]

        for batch in batches:
            for part, node in _new_lines(batch, wanted):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part, pa.binary()), pa.array([len(x) for x in part], pa.int64())], ["node", "line", "bytes"])

    return cut(docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "node long, line binary, bytes long").dropDuplicates(["node"]))


def joined_up(shingles: np.ndarray, counts: np.ndarray, left: np.ndarray, over: int = OVER, under: int = UNDER) -> np.ndarray:
    """Least index of each row's component under exact similarity; rows of the first block are compared with the others (all with all if there is one block).

    Rows are compared with one row at a time through an index of their shingles; rows already joined with it are left out, and nothing is
    compared any more once all are one component.
    """
    n = len(counts)
    root = np.arange(n)
    row = np.repeat(root, counts)
    order = np.argsort(shingles, kind="stable")
    members, row = shingles[order], row[order]
    distinct = np.ones(len(members), bool)
    distinct[1:] = (members[1:] != members[:-1]) | (row[1:] != row[:-1])
    members, row = members[distinct], row[distinct]
    sizes = np.bincount(row, minlength=n)
    first = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(members))))
    last = np.append(first[1:], len(members))
    own = np.argsort(row, kind="stable")
    at = np.concatenate([[0], np.cumsum(sizes)])
    others = np.ones(n, bool) if left.all() else ~left
    for i in np.flatnonzero(left).tolist():
        rest = others & (root != root[i])
        if not rest.any():
            if left.all():
                break
            continue
        mine = group[own[at[i] : at[i + 1]]]
        lo, many = first[mine], last[mine] - first[mine]
        hits = row[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        common = np.bincount(hits, minlength=n)
        good = np.flatnonzero(rest & (common > 0) & (under * common >= over * (sizes + sizes[i] - common)))
        if len(good):
            joined = np.append(root[good], root[i])
            root[np.isin(root, joined)] = joined.min()
    return root


def groups_joined(shingles: np.ndarray, counts: np.ndarray, group: np.ndarray, over: int = OVER, under: int = UNDER) -> np.ndarray:
    """Least index of each row's component under exact similarity within its group, of at most SMALL rows; groups are numbered from 0, one after the other.

    Which rows of a group have a member is a mask of bits. Lines share whole stretches, so few masks differ: the sizes of all intersections of a group come from the masks
    and how often each occurs. Members are told apart by 64 bits less those that number the rows.
    """
    n = len(counts)
    bits = np.uint64(max(1, n - 1).bit_length())
    packed = np.sort(S.mixed(shingles) >> bits << bits | np.repeat(np.arange(n, dtype=np.uint64), counts))
    packed = packed[np.diff(packed, prepend=~packed[:1]) != 0]
    row, member = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), packed >> bits
    size, of, begin = np.bincount(row, minlength=n), group[row], np.searchsorted(group, np.arange(int(group[-1]) + 2))
    first = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (of[1:] != of[:-1])]))
    mask, of = np.bitwise_or.reduceat(np.uint64(1) << (row - begin[of]).astype(np.uint64), first), of[first]
    several = np.diff(np.append(first, len(row))) > 1
    mask, of = mask[several], of[several]
    root = np.arange(n)
    two = np.flatnonzero(np.diff(begin) == 2)
    a, common = begin[two], np.bincount(of, minlength=len(begin) - 1)[two]
    a = a[(common > 0) & (under * common >= over * (size[a] + size[a + 1] - common))]
    root[a + 1] = a
    order = np.lexsort((mask, of))
    mask, of = mask[order], of[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(mask)), bool), (mask[1:] != mask[:-1]) | (of[1:] != of[:-1])]))
    mask, of, times = mask[first], of[first], np.diff(np.append(first, len(mask)))
    ends = np.searchsorted(of, np.arange(len(begin)))
    for g in np.flatnonzero((np.diff(begin) > 2) & (np.diff(ends) > 0)).tolist():
        a, b, lo, hi = begin[g], begin[g + 1], ends[g], ends[g + 1]
        has = (mask[lo:hi, None] >> np.arange(b - a, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
        common = (has.T * times[lo:hi]) @ has
        good = (common > 0) & (under * common >= over * (size[a:b, None] + size[a:b] - common))
        np.fill_diagonal(good, True)
        now = np.arange(b - a)
        while (low := np.where(good, now, b - a).min(axis=1)).tolist() != now.tolist():
            now = low
        root[a:b] = a + now
    return root


def _verify(t: pa.Table, starts: list[int], left: np.ndarray):
    """Groups of rows begin at `starts`; small whole groups are compared together, about S.AT_ONCE bytes at a time."""
    node, lines = t["node"].to_numpy(), t["line"].to_pylist()
    begin = np.array(starts, np.int64)
    sizes = np.diff(np.append(begin, len(node)))
    whole = np.logical_and.reduceat(left, begin)
    small = np.flatnonzero(whole & (sizes <= SMALL))
    out_node, out_root = [], []

    def tell(rows: np.ndarray, root: np.ndarray) -> None:
        other = np.flatnonzero(root != np.arange(len(root)))
        out_node.append(node[rows[other]])
        out_root.append(node[rows[root[other]]])

    for a, b in S.runs([b"".join(lines[begin[g] : begin[g] + sizes[g]]) for g in small.tolist()]):
        many = sizes[small[a:b]]
        rows = np.repeat(begin[small[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        tell(rows, groups_joined(*S.char_shingles([lines[r] for r in rows.tolist()]), np.repeat(np.arange(b - a), many)))
    for g in np.flatnonzero(~whole | (sizes > SMALL)).tolist():
        rows = np.arange(begin[g], begin[g] + sizes[g])
        tell(rows, joined_up(*S.char_shingles(lines[rows[0] : rows[-1] + 1]), left[rows]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out_node, out_root)], ["node", "root"])


def classes(docs: DataFrame, text: str, lines: int) -> DataFrame:
    """(node, root) of the lines that are similar to another line."""
    candidates = buckets(_bands(docs, text, lines))
    return components(in_blocks(_texts(docs, text, marks(candidates)), candidates, _verify, "node long, root long", "bytes"))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs needs rid. Per line: rid, key, line_no (from 0), class_id (null for a blank line), kept."""
    written = lines_of(docs, key, text)
    total = written.agg(F.sum("n")).first()[0] or 0
    lines = written.select("rid", "key", F.posexplode("nodes").alias("line_no", "node"))
    # The small sides of both joins are written first, so that a hot line or class of the large side can be split between tasks.
    placed = cut(lines.join(cut(classes(docs, text, total)), "node", "left").select("rid", "key", "line_no", F.coalesce("root", "node").alias("class_id")))
    place = F.struct(F.col("key").isNull().alias("none"), "key", "rid", "line_no")
    several = placed.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("class_id", "first.rid", "first.line_no")
    first = cut(several.select("class_id", F.col("rid").alias("first_rid"), F.col("line_no").alias("first_line")))
    joined = placed.join(first, "class_id", "left")
    kept = F.col("first_rid").isNull() | ((F.col("first_rid") == F.col("rid")) & (F.col("first_line") == F.col("line_no")))
    return joined.select("rid", "key", "line_no", "class_id", kept.alias("kept"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with rid, written to the shared folder so that rid stays."""
    return cut(docs.withColumn("rid", F.monotonically_increasing_id()))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", before: str | None = None) -> DataFrame:
    """docs with every text cut down to the lines that stay; same columns and rows. With `before`, the whole text too, under that name."""
    stored = numbered(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")))
    own = stored.select("rid", F.col("row")[key].alias("key"), F.col("row")[text].alias("text"))
    gone = line_table(own, "key", "text").filter("NOT kept").groupBy("rid").agg(F.collect_list("line_no").alias("gone"))
    left = stored.join(gone, "rid", "left").withColumn("lines", F.split(F.col("row")[text], "\n", -1))
    # Linear in the lines: the places that stay come from a hash set, then each is looked up.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    cleaned = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return left.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *([F.col("row")[text].alias(before)] if before else []))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every line of all documents with its class and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))  # only the table of lines keeps rid
    return line_table(docs).select(F.col("key").alias("doc_id"), "line_no", "class_id", "kept")
