"""Benchmark decontamination by a hash set of normalised n-grams.

Words are runs of ASCII letters (lower-cased), digits and all non-ASCII characters. A benchmark item's windows are its runs
of N consecutive words; an item of fewer words, but not none, is one window. The windows' hashes go into sorted
arrays, one per window length; every document's words are hashed over the same lengths with a rolling sum,
hits in the arrays are verified byte by byte, and the words inside verified windows are hit.

The hash set is a file of flat arrays that executors map into memory, with the size checked: of at most about MAX_WINDOWS windows, each
20 bytes and its share of the items' text. Items are cut into pieces of PIECE windows on the executors, and a larger benchmark is dealt by piece
into several such indexes (all of it is used, nothing is capped); documents are then scanned once for each, one index
at a time, and each scan adds to the findings of the one before. Scanning needs no shuffle; a task holds the words of about BYTES_AT_ONCE at a time. A lost
executor's tasks simply run again.

Nulls: a null text, in either table, has no words; null ids are kept for documents, and a null item id counts as the item
'null'. Repeated items with one id count as one item, and an item is told once however often it occurs; ties have no part in this. Repeated documents are scanned each. Very
long texts are scanned whole. Other columns are not read. Empty tables: no documents give an empty result, no items give documents without hits.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrules.llm import shingles as S
from txnrules.llm.mapped import Writer, opened
from txnrules.llm.runtime import cut, table

N = 10
MAX_WINDOWS, PIECE = 4_000_000, 10_000
BYTES_AT_ONCE = 1_000_000
FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


class Words:
    """Words of several normalised texts (words joined by one space): hashes, where they begin and end in the joined bytes, and each text's first."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"\n".join(texts) + b"\n"
        self.hashes, self.begin, text = S.word_hashes(self.bytes, [len(t) + 1 for t in texts])
        self.many = np.bincount(text, minlength=len(texts))
        self.first = np.cumsum(self.many) - self.many
        self.text = text
        b = np.frombuffer(self.bytes, np.uint8)
        self.end = np.flatnonzero(((b == 32) | (b == 10)) & np.concatenate([[False], (b[:-1] != 32) & (b[:-1] != 10)]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of `size` words inside a text."""
        if len(self.hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: len(self.text) - size + 1] == self.text[size - 1 :])
        total = np.zeros(len(self.hashes) - size + 1, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k : k + len(total)]
        return at, S.mixed(total[at])


def pieces_of(benchmark: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Written table (item, size, words, windows): parts of items with their window length, normalised text and number of windows."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = S.normal_words(t).split()
                size = min(n, len(words))
                for at in range(0, len(words) - size + 1 if size else 0, PIECE):
                    part = words[at : at + PIECE + size - 1]
                    rows.append((item, size, b" ".join(part), len(part) - size + 1))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "size", "words", "windows"])

    named = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return cut(named.mapInArrow(run, "item string, size int, words binary, windows long"))


def write_index(spark: SparkSession, pieces: pa.Table) -> str:
    """Ships an index of the pieces; its name on every executor."""
    writer = Writer("windows")
    words = Words(pieces["words"].to_pylist())
    sizes = pieces["size"].to_numpy()
    writer.add("text", np.frombuffer(words.bytes, np.uint8))
    names = [x.encode() for x in pieces["item"].to_pylist()]
    writer.add("names", np.frombuffer(b"".join(names), np.uint8))
    writer.add("name_at", np.cumsum([0, *map(len, names)]))
    for size in sorted(set(sizes.tolist())):
        at, h = words.windows(size)
        mine = sizes[words.text[at]] == size
        at, h = at[mine], h[mine]
        order = np.argsort(h, kind="stable")
        writer.add(f"hash/{size}", h[order])
        writer.add(f"begin/{size}", words.begin[at[order]])
        writer.add(f"piece/{size}", words.text[at[order]].astype(np.int32))
    return writer.ship(spark)


class Index:
    """An opened index. `find` gives (text, first word, length, items) of every verified window."""

    def __init__(self, name: str):
        self.arrays = opened(name)
        self.sizes = sorted(int(x.split("/")[1]) for x in self.arrays if x.startswith("hash/"))
        self.maps = {}
        for size in self.sizes:  # a bitmap of the hashes' first bits spares most searches
            bits = max(10, int(16 * len(self.arrays[f"hash/{size}"])).bit_length())
            marks = np.zeros(1 << bits, bool)
            marks[self.arrays[f"hash/{size}"] >> np.uint64(64 - bits)] = True
            self.maps[size] = np.uint64(64 - bits), marks

    def find(self, words: Words):
        for size in self.sizes:
            at, h = words.windows(size)
            shift, marks = self.maps[size]
            some = np.flatnonzero(marks[h >> shift])
            at, h = at[some], h[some]
            hashes, begins, pieces = (self.arrays[f"{x}/{size}"] for x in ("hash", "begin", "piece"))
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(lo < hi).tolist():
                word = int(at[k])
                window = words.bytes[int(words.begin[word]) : int(words.end[word + size - 1])]
                items = {self._name(int(pieces[x])) for x in range(int(lo[k]), int(hi[k])) if self._equals(int(begins[x]), window)}
                if items:
                    text = int(words.text[word])
                    yield text, word - int(words.first[text]), size, items

    def _equals(self, begin: int, window: bytes) -> bool:
        text = self.arrays["text"]
        end = begin + len(window)
        return end < len(text) and text[begin:end].tobytes() == window and int(text[end]) in (32, 10)

    def _name(self, piece: int) -> str:
        at = self.arrays["name_at"]
        return self.arrays["names"][at[piece] : at[piece + 1]].tobytes().decode()


def indexes(spark: SparkSession, benchmark: DataFrame, key: str = "item_id", text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> list[str]:
    """Shipped indexes over all items. Pieces come to the driver one index at a time."""
    pieces = pieces_of(benchmark, key, text, n)
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    blocks = int(total // max_windows) + 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    return [write_index(spark, pieces.filter(block == k).orderBy("item", "words").toArrow()) for k in range(blocks)]


def _scan(docs: DataFrame, name: str, last: bool) -> DataFrame:
    """docs has key, text, row, spans and items; the index's findings are added to the last two."""
    names = ["key", "row", "n_words", "spans", "items"] + ["text"] * (not last)
    carried = docs.schema["row"].dataType.simpleString()

    def run(batches):
        index = Index(name)
        for batch in batches:
            texts = [S.normal_words(t) for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                start, total = at, 0
                while at < len(texts) and (total < BYTES_AT_ONCE or at == start):
                    total += len(texts[at])
                    at += 1
                yield rows(index, batch.slice(start, at - start), texts[start:at])

    def rows(index, part, texts):
        words = Words(texts)
        spans = [[(s["start"], s["end"]) for s in x] for x in part.column("spans").to_pylist()]
        items = [set(x) for x in part.column("items").to_pylist()]
        for text, word, size, of in index.find(words):
            spans[text].append((word, word + size))
            items[text].update(of)
        merged = [[{"start": a, "end": b} for a, b in merge(x)] for x in spans]
        made = {
            "key": part.column("key"),
            "row": part.column("row"),
            "n_words": pa.array(words.many, pa.int64()),
            "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            "text": part.column("text"),
        }
        return pa.RecordBatch.from_arrays([made[n] for n in names], names)

    return docs.mapInArrow(run, f"key long, row {carried}, {FOUND}" + ", text string" * (not last))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, n_words, the hit word spans (merged, half-open), and the items found, sorted.

    `row` is a struct of the columns in `carry`, passed through.
    """
    found = docs.select(
        F.col(key).cast("long").alias("key"),
        F.col(text).alias("text"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("row"),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    built = indexes(docs.sparkSession, benchmark, n=n, max_windows=max_windows)
    for k, index in enumerate(built):
        last = k == len(built) - 1
        found = _scan(found, index, last)
        found = found if last else cut(found)  # one index in memory at a time
    return found


def without_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones; same columns."""
    found = scan(docs, benchmark, carry=tuple(docs.columns), **how)
    return found.filter(F.size("spans") == 0).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with the hit words cut out of the texts, from the first to the last character of each span; same columns."""
    found = scan(docs, benchmark, text=text, carry=tuple(docs.columns), **how)

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, s) if len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    return found.select(*[cut_out(F.col("row")[c], "spans").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def cut_spans(text: str, spans) -> str:
    at = [m.span() for m in WORD_BYTES.finditer(text.encode().translate(S.LOWER_OR_SPACE))]
    whole, out, last = text.encode(), [], 0
    for s in spans:
        out.append(whole[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*out, whole[last:]]).decode()


def words_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_ngram_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        words_hit("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = f"""
WITH n AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents, n),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark, n),
bs AS (SELECT item_id, ws, least({N}, len(ws)) AS size FROM b WHERE len(ws) > 0),
bw AS (
    SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
    FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM bs)),
dw AS (
    SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
    FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bs) WHERE len(ws) >= size)),
h AS (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.gram = bw.gram AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""
