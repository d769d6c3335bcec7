"""Byte-level BPE encoding and decoding with a transducer lexicon.

Frequent words are counted over all documents with one mergeable Misra-Gries summary per task (any word with more
than 1/SUMMARY of all words is certain to survive), summed by Spark, and the LEXICON most frequent are compiled
on the driver into a minimal acyclic transducer: common prefixes and suffixes are shared, and outputs summed
along a path give the word's place in a table of id sequences. The transducer, the merge table and the
tokens' bytes go into one file of flat arrays that Spark ships to every executor (SparkContext.addFile), where each
Python worker memory-maps it. Words outside the lexicon are merged exactly, lowest rank first and leftmost first.
The lexicon speeds encoding up and never changes its result. Decoding concatenates the tokens' bytes.

Encoding has no shuffle and a bounded memory: documents go through in small batches, and a worker's memo
of recent words is emptied when full. A lost executor's tasks run again elsewhere and fetch the file anew.

Nulls: a null text counts as empty and gives no ids and an empty decoded text; a null id is kept. Very long texts and
words need time n log n. Repeated rows are encoded each. Other columns are not read. An empty table gives an empty
result. The added token's string in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import atexit
import heapq
import json
import mmap
import os
import shutil
import tempfile
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrules.llm.characters import LETTER, UNKNOWN, WHITE, kinds
from txnrules.llm.runtime import table

LEXICON = 32_768
SUMMARY = 32_768
MEMO = 200_000
SMALL = 256  # documents encoded at a time
SHORT = 48  # bytes of a word that is merged together with others
NEVER = 1 << 40
END = "\U0010ffff"  # ends a text or a word where several are one; it is no character, so texts that have it are of an unknown kind
ENCODED = "key long, ids array<int>, decoded string"

# The pre-tokenizer's fixed pattern, with white space by its Unicode property.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """What WORD finds in all texts, with numpy over their characters, and how many words each text has; the texts hold no character of an unknown kind.

    Runs of letters, digits or other marks are words, with the one space before them. White space before a word is a word but for its last character, which is one of its own if it is no
    space; at the end of a text it is one word. An apostrophe that begins a word takes the ending after it.
    """
    chars = np.frombuffer(END.join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = kinds()[chars]
    over = chars == ord(END)
    kind[over] = UNKNOWN
    start = ~over
    start[1:] &= kind[1:] != kind[:-1]
    after = 1 + np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE))
    after = after[~over[after]]
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    at = np.flatnonzero((chars == 39) & start)
    if len(at):
        first, second = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((second == ord("e")) & np.isin(first, [ord("r"), ord("v")])) | ((first == ord("l")) & (second == ord("l")))
        start[at[one | two] + 1] = False
        for ends in (at[one] + 2, at[two] + 3):
            start[ends[kind[ends] == LETTER]] = True
    kept = np.flatnonzero(~over)
    begins = start[kept]
    spaced = np.full(len(kept) + int(begins.sum()), ord(END), np.uint32)
    spaced[np.arange(len(kept)) + np.cumsum(begins)] = chars[kept]
    words = spaced.tobytes().decode("utf-32-le").split(END)[1:]
    return words, np.diff(np.concatenate([[0], np.cumsum(start)[over]]))


def words_of(texts: list[str]) -> list[list[str]]:
    """Words of each text; texts with characters of an unknown kind go through the pattern."""
    plain = [t.isascii() or not (kinds()[np.frombuffer(t.encode("utf-32-le"), np.uint32)] == UNKNOWN).any() for t in texts]
    words, counts = split_words([t if ok else "" for t, ok in zip(texts, plain, strict=True)])
    ends = np.cumsum(counts).tolist()
    return [words[a:b] if ok else WORD.findall(t) for t, ok, a, b in zip(texts, plain, [0, *ends], ends, strict=False)]


class Merges:
    """Token bytes and ranked merges; encodes one word exactly."""

    def __init__(self, tokens: list[bytes], single: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.tokens = tokens
        self.single = single.tolist()
        self.single_ids, self.merged = np.array(single, np.int64), np.array(merged, np.int64)
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], order
        self.rank = {(a, b): (k, m) for k, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), merged.tolist(), strict=True))}

    def encode_ordinary(self, word: str) -> list[int]:
        return self.encode(word.encode())

    def encode(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(k, i, m, a, b) for k, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((m, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], m, ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], m))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], m))
        return [x for x in ids if x >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER if it doesn't merge."""
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[place] == keys, self.pair_rank[place], NEVER)

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Many words at once: each round merges the lowest-ranked pair of every word wherever it occurs, leftmost first.

        A merge never makes a pair of lower rank than its own, so this gives what one merge at a time gives.
        """
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= SHORT]
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.encode(w)
        if not short:
            return out
        ids = self.single_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        rank = np.full(len(ids), NEVER)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks(ids[inside], ids[inside + 1])
        done_ids, done_word = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = best == NEVER
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            new_run = np.diff(at, prepend=-2) != 1
            at = at[(np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # each merge before it took one token away
            ids, word, rank = ids[keep], word[keep], rank[keep]
            changed = np.zeros(len(ids), bool)
            changed[now] = True
            changed[now[now > 0] - 1] = True
            stale = np.flatnonzero(changed)
            rank[stale] = NEVER
            stale = stale[stale + 1 < len(ids)]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.ranks(ids[stale], ids[stale + 1])
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(short))).tolist()
        ids, begin = ids[order].tolist(), 0
        for k, end in zip(short, ends, strict=True):
            out[k] = ids[begin:end]
            begin = end
        return out


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Flat arrays of a byte-level BPE vocabulary file."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    vocabulary = stored["model"]["vocab"]
    added = {x["content"]: x["id"] for x in stored["added_tokens"]}
    tokens = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
    for token, k in vocabulary.items():
        tokens[k] = bytes(of_letter[c] for c in token)
    for token, k in added.items():
        tokens[k] = token.encode()
    pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in stored["model"]["merges"]]
    return {
        "single": np.array([vocabulary[c] for c in byte_letters()], np.int32),
        "left": np.array([vocabulary[a] for a, _ in pairs], np.int32),
        "right": np.array([vocabulary[b] for _, b in pairs], np.int32),
        "merged": np.array([vocabulary[a + b] for a, b in pairs], np.int32),
        "token_at": np.cumsum([0, *map(len, tokens)]).astype(np.int64),
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "added": np.array(sorted(added.values()), np.int32),
    }


def merges_of(arrays) -> Merges:
    at, joined = arrays["token_at"].tolist(), bytes(arrays["token_bytes"])
    tokens = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
    return Merges(tokens, arrays["single"], arrays["left"], arrays["right"], arrays["merged"])


def transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of distinct, sorted, non-empty words, built in one pass.

    When the next word leaves a branch, the branch's states are replaced by equal registered ones, last state first.
    An arc's output is the number of words that come before the ones it leads to, so a path's sum is the word's place.
    `arc` is source state and byte, in ascending order.
    """
    register: dict[tuple, int] = {}
    kept: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(state) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(kept)
            kept.append((state[0], list(state[1])))
        return register[key]

    path, last = [[False, []]], b""
    for word in [*words, None]:
        shared = 0 if word is None else len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        if word is not None:
            path.extend([False, []] for _ in word[shared:])
            path[-1][0] = True
            last = word
    root = settle(path[0])
    below = []  # words below each state; targets come before their sources
    for final, arcs in kept:
        below.append(final + sum(below[t] for _, t in arcs))
    arc, target, out = [], [], []
    for state, (final, arcs) in enumerate(kept):
        number = int(final)
        for b, t in arcs:
            arc.append(state << 8 | b)
            target.append(t)
            out.append(number)
            number += below[t]
    return {
        "arc": np.array(arc, np.int64),
        "target": np.array(target, np.int32),
        "out": np.array(out, np.int32),
        "final": np.array([f for f, _ in kept], np.uint8),
        "root": np.array([root], np.int32),
    }


def compile_lexicon(words: list[str], vocabulary: dict[str, np.ndarray], path: str) -> None:
    """Write the file of flat arrays: vocabulary, transducer of the words, and their ids."""
    merges = merges_of(vocabulary)
    spelled = sorted({w.encode() for w in words if w})
    ids = merges.encode_many(spelled)
    arrays = vocabulary | transducer(spelled)
    arrays |= {"ids_at": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([x for i in ids for x in i], np.int32)}
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        head[name] = (at, len(a), a.dtype.str)
        body.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(body[-1])
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    with open(path, "wb") as f:
        f.write(len(top).to_bytes(8, "little") + top + b"".join(body))


def one_word(merges: Merges, arrays) -> Merges | tiktoken.Encoding:
    """What merges a word that is not in the lexicon: tiktoken, which goes by the rank of the merged bytes, where the file's ids are the ranks of its merges; else `Merges`."""
    ids = arrays["merged"]
    if len(ids) and (np.diff(ids) <= 0).any():
        return merges
    added = set(arrays["added"].tolist())
    ranks = {t: k for k, t in enumerate(merges.tokens) if t and k not in added}
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


class Lexicon:
    """The memory-mapped file, and a memo of words: their ids (as int32 bytes) and decoded bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self.map[:8], "little")
        arrays = {n: np.frombuffer(self.map, d, k, 8 + size + at) for n, (at, k, d) in json.loads(self.map[8 : 8 + size]).items()}
        self.merges = merges_of(arrays)
        self.arc, self.target, self.out, self.final, self.ids_at, self.ids = (arrays[n] for n in ("arc", "target", "out", "final", "ids_at", "ids"))
        self.root = int(arrays["root"][0])
        self.merged = one_word(self.merges, arrays)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.added = {self.merges.tokens[k].decode(): k for k in arrays["added"].tolist()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1; all words walk the transducer together, a byte at a time."""
        place = np.full(len(words), -1)
        sizes = np.array([len(w) for w in words])
        if not len(self.arc) or not len(words):
            return place
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        at, state, number = np.flatnonzero(sizes), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        for step in range(int(sizes.max(initial=0))):
            wanted = state[at] << 8 | flat[begin[at] + step]
            k = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            there = self.arc[k] == wanted
            at, k = at[there], k[there]
            number[at] += self.out[k]
            state[at] = self.target[k]
            ended = sizes[at] == step + 1
            place[at[ended]] = np.where(self.final[state[at[ended]]], number[at[ended]], -1)
            at = at[~ended]
            if not len(at):
                break
        return place

    def learn(self, words: list[str]) -> None:
        """Put words into the memo: from the lexicon where they are in it, else by merging."""
        spelled = [w.encode() for w in words]
        places = self.places(spelled).tolist()
        unseen = map(self.merged.encode_ordinary, [w for w, k in zip(words, places, strict=True) if k < 0])
        starts, ids = self.ids_at.tolist(), self.ids
        for w, k in zip(words, places, strict=True):
            found = ids[starts[k] : starts[k + 1]].tolist() if k >= 0 else next(unseen)
            self.memo[w] = array("i", found).tobytes(), self.decode(found)

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.merges.tokens
        return b"".join([tokens[i] for i in ids])

    def words(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokenized words; an added token is a word of its own."""
        special = {k: self.split.split(t) for k, t in enumerate(texts) if any(x in t for x in self.added)} if self.split else {}
        lists = words_of(["" if k in special else t for k, t in enumerate(texts)])
        for k, parts in special.items():
            lists[k] = [w for part in parts for w in ([part] if part in self.added else WORD.findall(part))]
        return lists

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """Per text, the memo's entries of its words."""
        memo, lists = self.memo, self.words(texts)
        if len(memo) > MEMO:
            memo.clear()
        for token, k in self.added.items():
            memo[token] = array("i", [k]).tobytes(), self.decode([k])
        self.learn(list({w for words in lists for w in words if w not in memo}))
        return [[memo[w] for w in words] for words in lists]


def frequent_words(docs: DataFrame, text: str = "text", size: int = LEXICON, summary: int = SUMMARY) -> list[str]:
    """The most frequent words of all documents; at most `size` reach the driver."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SMALL):
                for words in words_of([t or "" for t in batch.column(0).slice(at, SMALL).to_pylist()]):
                    counts.update(words)
                if len(counts) > 8 * summary:
                    counts = shrunk(counts, summary)
        counts = shrunk(counts, summary)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = docs.select(text).mapInArrow(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def shrunk(counts: Counter, k: int) -> Counter:
    """Misra-Gries: at most k words stay, less the count of the (k+1)th."""
    if len(counts) <= k:
        return counts
    less = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - k - 1)[len(counts) - k - 1])
    return Counter({w: n - less for w, n in counts.items() if n > less})


def ship(spark: SparkSession, words: list[str], vocabulary_path: str) -> str:
    """Compile the lexicon and hand the file to Spark; returns its name on every executor."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file from the driver while it runs
    path = os.path.join(folder, name)
    compile_lexicon(words, read_vocabulary(vocabulary_path), path)
    spark.sparkContext.addFile(path)
    return name


_open: dict[str, Lexicon] = {}


def opened(name: str) -> Lexicon:
    if name not in _open:
        _open.clear()
        _open[name] = Lexicon(SparkFiles.get(name))
    return _open[name]


def encode(docs: DataFrame, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ids, and the text that decoding the ids gives. `lexicon` is a name that `ship` returned."""

    def run(batches):
        lex = opened(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, SMALL):
                part = batch.slice(at, SMALL)
                sizes, ids, decoded = [0], [], []
                for entries in lex.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids.append(b"".join([e[0] for e in entries]))
                    decoded.append(b"".join([e[1] for e in entries]).decode("utf-8", "replace"))
                    sizes.append(len(ids[-1]) // 4)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ENCODED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_transducer_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents: number of tokens and digests of ids and decoded text."""
    docs = table(spark, sf_dir, "documents")
    lexicon = ship(spark, frequent_words(docs), vocabulary or default_vocabulary())
    return encode(docs, lexicon).select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
