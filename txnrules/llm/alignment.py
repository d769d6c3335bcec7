"""Alignment of two tokenizers' tokens, and how often their ids are linked over all documents.

A document is a space and its text; both tokenizers' tokens cut its bytes. Offsets at which tokens of both end cut them into groups, and all A-B pairs of occurrences within a group are links.

Both tokenizers work on stretches that begin at a space between other characters: no token of either, and no rule that finds them, reaches over such a place (`stretches`), so
tokens, groups and links of a document are those of its stretches in order. A task aligns each different stretch once and keeps up to MEMO of them.
New stretches are laid end to end. The two sorted lists of token ends are merged by merge path: binary searches on the diagonals of
the merge grid cut it into independent pieces of PIECE ends each (`diagonals`), a piece tells which tokens overlap, as places in groups numbered within the piece
(`overlaps`), and the group that is open at a piece's end goes on in the next one (`groups`). A text without spaces is one stretch, however long.

Documents with their distinct linked pairs are written once. Spark counts the documents of each pair and takes the highest count of each A id. Counts come back to
the documents in two ways that together are exact: at most FREQUENT of the pairs, those above a count that is chosen from a histogram, go to every task as a memory-mapped file, and the other pairs of
documents are joined with their counts by pair. Pairs have no more rows than documents, so no pair is hot, and only sums per document are grouped.

Nulls: texts that are null or empty, or that the B tokenizer does not give back byte for byte (it reads U+2581 as a space), have no tokens, zeros and an
empty digest. Null ids are kept; repeated rows count each. Very long texts are read whole. Ties for an A id's highest count all count as best. Added tokens'
strings are plain text. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrules.llm.bpe import read_vocabulary
from txnrules.llm.mapped import Writer, opened
from txnrules.llm.runtime import cut, table
from txnrules.llm.stretches import stretches

PIECE = 65_536  # merged ends of a piece
MEMO, MEMO_CHARS, LONGEST = 300_000, 8_000_000, 64  # stretches and characters after which a task forgets; the longest stretch that it looks up again
FREQUENT = 1_000_000
CHARS_AT_ONCE = 500_000
LONG = 100_000  # characters of a text that the regular expressions of tiktoken may not stand
ALIGNED = "key long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs array<long>, times array<long>"


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge path: how many of a and of b (sorted) are among the first `at` of their merge, by binary search along each diagonal; equal ends stay together."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(at), bool)
        before[open_] = a[middle[open_]] <= b[at[open_] - middle[open_] - 1]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    i, j = low, at - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of a piece's tokens, numbered from 0 within it, and how many of them end in it."""
    place = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    common = a[b[place] == a] if len(a) and len(b) else a[:0]
    return np.searchsorted(common, a), np.searchsorted(common, b), len(common)


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token, from the sorted ends of both lists; both end at the same offset."""
    total = len(a) + len(b)
    i, j = diagonals(a, b, np.arange(0, total + PIECE, PIECE).clip(max=total))
    of_a, of_b, done = [], [], 0
    for k in range(len(i) - 1):
        x, y, ended = overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        of_a.append(x + done)  # the group that was open when the last piece ended is the first of this one
        of_b.append(y + done)
        done += ended
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *of_a]), np.concatenate([none, *of_b])


class Tokens:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a_path = a_path
        read = read_vocabulary(a_path)
        at, joined = read["token_at"].tolist(), read["token_bytes"].tobytes()
        added = set(read["added"].tolist())
        self.a_bytes = [b"" if k in added else joined[x:y] for k, (x, y) in enumerate(zip(at, at[1:], strict=False))]
        # The id of a byte-level token is the rank of the merge that makes it.
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks={t: k for k, t in enumerate(self.a_bytes) if t}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(k)[3:-1], 16)]) if self.b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([str(k).encode() for k in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        self._library = None

    def encode_a(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.a.encode_ordinary(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.a_path)
            self._library.no_truncation()
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids


# Fixed value: the pattern of the byte-level tokenizer's words.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pairs_of(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int, many_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all groups: pair is id of A * many_b + id of B. Pairs of a group are spelled out where it is small, and made of its distinct ids where it is large."""
    size_a, size_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    first_b = np.cumsum(size_b) - size_b
    large = size_a * size_b > 4096
    times_each = np.where(large, 0, size_b)[in_a]
    at = np.repeat(first_b[in_a] - np.cumsum(times_each) + times_each, times_each) + np.arange(times_each.sum())
    group, pair = [np.repeat(in_a, times_each)], [np.repeat(a, times_each) * many_b + b[at]]
    times = [np.ones(len(at), np.int64)]
    first_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(large).tolist():
        x, nx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        group.append(np.full(len(x) * len(y), g))
        pair.append((x[:, None] * many_b + y).ravel())
        times.append((nx[:, None] * ny).ravel())
    return np.concatenate(group), np.concatenate(pair), np.concatenate(times)


class Aligner:
    """Aligns stretches and remembers them; the columns of each are numbers of A tokens, B tokens, groups and links."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.known = self.chars = 0
        self.spelled: list[bytes] = []  # groups; None if the tokens don't give the bytes back
        self.counts, self.first = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> dict[str, int]:
        t = self.tokens
        b_lists = t.b.encode(new, num_threads=1)
        a_lists = [t.encode_a(" " + x) for x in new]
        good = [b"".join([t.b_bytes[k] for k in y]) == (" " + x).encode() == b"".join([t.a_bytes[k] for k in z]) for x, y, z in zip(new, b_lists, a_lists, strict=True)]
        kept = [k for k, ok in enumerate(good) if ok]
        n_a, n_b = (np.array([len(x[k]) for k in kept], np.int64) for x in (a_lists, b_lists))
        a, b = (np.fromiter((i for k in kept for i in x[k]), np.int64, int(n.sum())) for x, n in ((a_lists, n_a), (b_lists, n_b)))
        in_a, in_b = groups(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
        n = int(in_a[-1]) + 1 if len(in_a) else 0
        owner = np.zeros(n, np.int64)  # the stretch of each group
        owner[in_a] = np.repeat(np.arange(len(kept)), n_a)
        group, pair, times = pairs_of(a, b, in_a, in_b, n, len(t.b_bytes))
        order = np.argsort(owner[group], kind="stable")
        pair, times = pair[order], times[order]
        many = np.bincount(owner[group], minlength=len(kept))
        links = np.bincount(owner[group], times, len(kept)).astype(np.int64)
        counts = np.zeros((len(new), 4), np.int64)
        counts[kept] = np.stack([n_a, n_b, np.bincount(owner, minlength=len(kept)), links], axis=1)
        sizes = np.zeros(len(new), np.int64)
        sizes[kept] = many
        spelled = iter(self.spell(a, b, in_a, in_b, n_a, n_b))
        self.spelled.extend(next(spelled) if ok else None for ok in good)
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
        places = dict(zip(new, range(self.known, self.known + len(new)), strict=True))
        self.known += len(new)
        self.chars += sum(map(len, new))
        self.memo.update((x, k) for x, k in places.items() if len(x) <= LONGEST)
        return places

    def spell(self, a, b, in_a, in_b, n_a, n_b) -> list[bytes]:
        """The groups of every stretch as text, a1,a2|b1;a3|b2: in each group the A tokens, then the B tokens, each with the sign that follows it."""
        t = self.tokens
        last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (in_a, in_b))
        before_b = np.searchsorted(in_b, in_a)  # B tokens of earlier groups
        upto_a = np.searchsorted(in_a, in_b, side="right")  # A tokens of this and earlier groups
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + before_b] = [t.a_names[k] + (b"|" if e else b",") for k, e in zip(a.tolist(), last_a.tolist(), strict=True)]
        names[np.arange(len(b)) + upto_a] = [t.b_names[k] + (b";" if e else b",") for k, e in zip(b.tolist(), last_b.tolist(), strict=True)]
        ends = np.cumsum(n_a + n_b).tolist()
        names = names.tolist()
        return [b"".join(names[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str]):
        """(counts, digests, pairs, times, ends of each text's pairs) of all texts; pairs are distinct and ascending within a text."""
        if self.known > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        parts = [stretches(x) if x else [] for x in texts]
        flat = [x for p in parts for x in p]
        place = np.fromiter(map(self.memo.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(place < 0).tolist()):
            new = self.learn(list(dict.fromkeys([flat[k] for k in missing])))
            place[missing] = [new[flat[k]] for k in missing]
        n = np.array([len(p) for p in parts])
        doc = np.repeat(np.arange(len(texts)), n)
        digests, ends, good = [], np.cumsum(n).tolist(), np.zeros(len(texts), bool)
        places = place.tolist()
        for k, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
            spelled = [self.spelled[p] for p in places[x:y]]
            good[k] = y > x and None not in spelled
            digests.append(hashlib.sha256(b";".join(spelled)).hexdigest() if good[k] else "")
        used = good[doc]
        doc, place = doc[used], place[used]
        counts = np.stack([np.bincount(doc, self.counts[place, c], len(texts)) for c in range(4)], axis=1).astype(np.int64)
        many = np.diff(self.first)[place]
        at = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
        owner, pair, times = np.repeat(doc, many), self.pairs[at], self.times[at]
        width = len(self.tokens.a_bytes) * len(self.tokens.b_bytes)
        keyed = owner * width + pair
        distinct, total = np.unique(keyed, return_counts=True)
        more = np.flatnonzero(times > 1)
        np.add.at(total, np.searchsorted(distinct, keyed[more]), times[more] - 1)
        return counts, digests, distinct % width, total, np.searchsorted(distinct // width, np.arange(len(texts)), side="right")


def batches_of(texts: list[str]):
    """Slices of texts of about CHARS_AT_ONCE characters; a longer text is a slice of its own."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > CHARS_AT_ONCE:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


_tokens: dict[tuple[str, str], Tokens] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, digest of its groups, its distinct linked pairs (id of A * number of B ids + id of B), ascending, and how often each is linked."""

    def run(batches):
        if (a_path, b_path) not in _tokens:
            _tokens[a_path, b_path] = Tokens(a_path, b_path)
        aligner = Aligner(_tokens[a_path, b_path])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches_of(texts):
                counts, digests, pairs, times, ends = aligner.align(texts[a:b])
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(x)) for x in (pairs, times)]
                columns = [batch.column(0).slice(a, b - a), *[pa.array(counts[:, c]) for c in range(4)], pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(linked: DataFrame, many_b: int) -> DataFrame:
    """Per pair: the number of documents that hold it linked, and whether that is the highest count of its A id."""
    counted = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = cut(counted.withColumn("a", F.expr(f"pair div {many_b}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of A
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def ship_frequent(spark: SparkSession, counts: DataFrame, size: int) -> tuple[str, int]:
    """A file with the pairs of the highest counts, at most `size` of them, and the count from which on it has all pairs."""
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = {r.level: (r.pairs, r.least) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()}  # at most 16 * 63 rows
    total, least = 0, 2**62
    for k in sorted(histogram, reverse=True):
        total += histogram[k][0]
        if total > size:
            break
        least = histogram[k][1]
    found = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(found["pair"].to_numpy())
    writer = Writer("pairs")
    for name, kind in (("pair", np.int64), ("n", np.int64), ("best", np.uint8)):
        writer.add(name, found[name].to_numpy()[order].astype(kind))
    return writer.ship(spark), least


def with_counts(linked: DataFrame, counts: DataFrame, frequent: int | None = None) -> DataFrame:
    """linked (of `aligned`, with rid) with n_best and count_sum instead of pairs and times."""
    spark = linked.sparkSession
    file, least = ship_frequent(spark, counts, FREQUENT if frequent is None else frequent)
    kept = ["rid", "key", "n_a", "n_b", "n_groups", "n_links", "digest"]

    def look_up(batches):
        arrays = opened(file)
        known, n, best = arrays["pair"], arrays["n"], arrays["best"]
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (len(kept), len(kept) + 1))
            sizes = np.diff(batch.column(len(kept)).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for out, values in zip(sums, (best, n), strict=True):
                np.add.at(out, doc[hit], times[hit] * values[place[hit]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, sums), *lists], [*kept, "n_best", "count_sum", "pairs", "times"])

    told = cut(linked.select(*kept, "pairs", "times").mapInArrow(look_up, "rid long, " + ALIGNED.replace("pairs", "n_best long, count_sum long, pairs")))
    rest = told.filter(F.size("pairs") > 0).select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
    rare = rest.join(counts.filter(F.col("n") < least), "pair")
    sums = rare.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    joined = told.drop("pairs", "times").join(sums, "rid", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("more_best", "more", "rid")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, digest, n_best, count_sum."""
    many_b = vocabulary_size(b_path)
    linked = cut(aligned(docs, a_path, b_path, key, text).withColumn("rid", F.monotonically_increasing_id()), compression="zstd")
    return with_counts(linked, cut(pair_counts(linked, many_b)))


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_merge_path_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    found = align(table(spark, sf_dir, "documents"), *default_vocabularies())
    return found.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
