"""Packing token sequences by vector bin packing.

Texts are encoded and dealt into sequences under three limits at once: tokens, segments (pieces of a sequence) and loss-bearing tokens. Each task fills one
sequence after the other from a pool of waiting pieces: of those that fit, the one goes in whose vector (tokens, 1, loss tokens, each as
part of its limit) has the largest dot product with the room that is left, so a sequence short of segments takes long pieces, and one short of loss tokens takes
prompts. When nothing fits whole, a piece is cut at the room that is left. A sequence that ends up below the token limit, because the input ends or
another limit is reached, is cut back to the power of two below it (no padding there) and the rest waits for the next one. So a sequence is full or
a power of two long, and a task ends with at most one sequence for each power of two, unless another limit than tokens is what binds.

There is no shuffle: a task packs its own rows and holds some 2 * POOL pieces, of at most a sequence each, or two sequences of smaller ones. Sequence ids are the task's number and a
count, so a task that runs again gives the same rows.

Tokens: words are found as the tokenizer finds them, by Unicode category, with numpy over all texts of a batch; each different word is encoded
once a task (a memo of at most MEMO words). Texts with an added token's string, or with a character that this Python's Unicode doesn't know, go to the library whole.

Nulls: a null text is empty, and is just the end id; a null key is kept; a null loss flag bears no loss. Repeated rows are packed each. Ties between pieces go to the one
that came first into the pool. Very long texts are read whole, and cut. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrules.llm.bpe import byte_letters
from txnrules.llm.characters import NUMBER, UNKNOWN, WHITE, kinds
from txnrules.llm.runtime import table

TOKENS, SEGMENTS, LOSS = 4096, 256, 4096
END = 2
POOL = 1024  # pieces that wait in a task
MEMO = 400_000  # words that a task remembers
CHARS_AT_ONCE = 500_000
PACKED = "key long, start long, ids binary, loss_tokens long, doc_tokens long, sequence long, offset long"


def normal(text: str) -> str:
    """As the tokenizer normalizes: composed, and each character lower-cased by itself (a final sigma is no special case)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of all normalized texts, and how many each text has: runs of letters, single digits, runs of other characters, and the endings 's 't 're 've 'm 'll 'd
    where the apostrophe begins a word."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = kinds()[chars]
    start = kind != WHITE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at = np.flatnonzero((chars == 39) & start)
    if len(at):
        after, second = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
        one = np.isin(after, [ord(c) for c in "stmd"])
        two = ((second == ord("e")) & np.isin(after, [ord("r"), ord("v")])) | ((after == ord("l")) & (second == ord("l")))
        start[at[one | two] + 1] = False
        for ends in (at[one] + 2, at[two] + 3):
            start[ends[kind[ends] != WHITE]] = True
    kept = np.flatnonzero(kind != WHITE)
    begins = start[kept]
    spaced = np.full(len(kept) + int(begins.sum()), 32, np.uint32)
    spaced[np.arange(len(kept)) + np.cumsum(begins)] = chars[kept]
    words = spaced.tobytes().decode("utf-32-le").split(" ")[1:]
    before = np.concatenate([[0], np.cumsum(start)])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.concatenate([[0], before[ends]]))


def word_encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """An encoder of words that are each followed by a space, and which tokens end a word.

    In the file a word's last byte is a token of its own kind, and a token's id is the rank of the merge that makes it. With a space for the word's end the same
    tokens are byte strings, and a last byte and its space, whose ids are below all merges', are merged before anything else; so merging by rank gives the file's tokens.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    merged = {a + b for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])}
    suffix = model["end_of_word_suffix"]
    ranks, ends = {}, np.zeros(1 + max(model["vocab"].values()), bool)
    for token, k in model["vocab"].items():
        ended = token.endswith(suffix)
        letters = token[: -len(suffix)] if ended else token
        if token in merged or len(letters) == 1:  # not the added tokens
            ranks[bytes(of_letter[c] for c in letters) + b" " * ended] = k
            ends[k] = ended
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), ends


class Encoder:
    """Encodes texts exactly as the tokenizers library does with the file at `path`, and puts `end` after each."""

    def __init__(self, path: str, end: int = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.ends = word_encoder(path)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        ids = self.words.encode_to_numpy(" ".join([*words, ""]), disallowed_special=()).astype(np.int32)
        self.sizes = np.concatenate([self.sizes, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if any(x in t for x in self.added)]
        plain = [normal(t) for t in texts]
        if unknown := [k for k, t in enumerate(plain) if not t.isascii() and (kinds()[np.frombuffer((t + texts[k]).encode("utf-32-le"), np.uint32)] == UNKNOWN).any()]:
            whole = sorted({*whole, *unknown})
        for k in whole:
            plain[k] = ""
        words, counts = split_words(plain)
        if len(self.memo) > MEMO:
            self.forget()
        memo = self.memo
        if new := [w for w in dict.fromkeys(words) if w not in memo]:
            self.learn(new)
        place = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        sizes, first = self.sizes, np.cumsum(self.sizes) - self.sizes
        many = sizes[place]
        ids = self.ids[np.repeat(first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(counts)]
        out = [np.append(ids[a:b], np.int32(self.end)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in whole:
            out[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.end], np.int32)
        return out


class Packer:
    """Fills sequences from a pool of pieces (key, start, ids, whether they bear loss, tokens of the whole example)."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, first_sequence: int):
        self.limits, self.most, self.sequence = (tokens, segments, loss), pool, first_sequence
        self.pieces: list[tuple] = []
        self.free: list[int] = []
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each piece; 0 tokens: taken
        self.waiting = self.waiting_tokens = 0

    def add(self, piece: tuple) -> None:
        if not self.free:
            more = max(64, len(self.pieces))
            self.free = list(range(len(self.pieces) + more - 1, len(self.pieces) - 1, -1))
            self.pieces.extend([None] * more)
            self.tokens, self.loss = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.tokens, self.loss))
        k = self.free.pop()
        self.pieces[k], self.tokens[k] = piece, len(piece[2])
        self.loss[k] = len(piece[2]) if piece[3] else 0
        self.waiting += 1
        self.waiting_tokens += len(piece[2])

    def take(self, k: int) -> tuple:
        piece, self.pieces[k], self.tokens[k], self.loss[k] = self.pieces[k], None, 0, 0
        self.free.append(k)
        self.waiting -= 1
        self.waiting_tokens -= len(piece[2])
        return piece

    def fill(self) -> list[tuple]:
        """The pieces of the next sequence."""
        tokens, segments, loss = self.limits
        scale = (1 / tokens, 1 / segments, 1 / max(loss, 1))
        room, inside, chosen = tokens, segments, []
        left = loss
        while room and inside and self.waiting:
            fits = (self.tokens <= room) & (self.loss <= left) & (self.tokens > 0)
            gain = self.tokens * (room * scale[0] ** 2) + self.loss * (left * scale[2] ** 2) + inside * scale[1] ** 2
            k = int(np.argmax(np.where(fits, gain, -1.0)))
            if fits[k]:
                piece = self.take(k)
            else:  # none fits whole: the one of which most does is cut
                most = np.where(self.tokens > 0, np.minimum(self.tokens, np.where(self.loss > 0, min(room, left), room)), 0)
                k = int(np.argmax(most))
                n = int(most[k])
                if not n:
                    break
                key, start, ids, bears, total = self.take(k)
                self.add((key, start + n, ids[n:], bears, total))
                piece = (key, start, ids[:n], bears, total)
            chosen.append(piece)
            room, inside, left = room - len(piece[2]), inside - 1, left - (len(piece[2]) if piece[3] else 0)
        return self.trimmed(chosen, tokens - room) if room else chosen

    def trimmed(self, chosen: list[tuple], filled: int) -> list[tuple]:
        """Cut back to the power of two below; what is over waits again."""
        over = filled - (1 << max(filled.bit_length() - 1, 0)) if filled else 0
        while over:
            key, start, ids, bears, total = chosen.pop()
            n = min(over, len(ids))
            if n < len(ids):
                chosen.append((key, start, ids[: len(ids) - n], bears, total))
            self.add((key, start + len(ids) - n, ids[len(ids) - n :], bears, total))
            over -= n
        return chosen

    def pack(self, down_to: int, least: int = 0):
        """Rows of sequences, until at most `down_to` pieces or fewer than `least` tokens wait."""
        while self.waiting > down_to and self.waiting_tokens >= least:
            at = 0
            for key, start, ids, bears, total in self.fill():
                yield key, start, ids.tobytes(), len(ids) if bears else 0, total, self.sequence, at
                at += len(ids)
            self.sequence += 1


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


def pack(
    examples: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", loss: Column | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = LOSS, end: int = END, pool: int = POOL
) -> DataFrame:
    """A row per piece: key, start (in its example), ids (little-endian, 4 bytes each), loss_tokens, doc_tokens (of its example), sequence, offset (in its sequence).

    `loss` says of each example whether its tokens bear loss (all do if it is left out), for instance role = 'assistant' of the turns of conversations.
    """
    if min(tokens, segments, loss_tokens) < 1:
        raise ValueError("limits are 1 at least")

    def run(batches):
        encoder = Encoder(vocabulary, end)
        packer = Packer(tokens, segments, loss_tokens, pool, TaskContext.get().partitionId() << 36)

        def rows(found):
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4], strict=True)], ["key", "start", "ids", "loss_tokens", "doc_tokens", "sequence", "offset"])

        for batch in batches:
            keys, texts, bears = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for a, b in batches_of(texts):
                for k, ids in enumerate(encoder.encode(texts[a:b]), a):
                    for at in range(0, len(ids), tokens):
                        packer.add((keys[k], at, ids[at : at + tokens], bool(bears[k]), len(ids)))
                    if packer.waiting > 2 * pool and packer.waiting_tokens > 2 * tokens:
                        yield rows(packer.pack(pool, 2 * tokens))
        while packer.waiting:
            yield rows(packer.pack(max(0, packer.waiting - pool)))

    flag = F.lit(True) if loss is None else F.coalesce(loss, F.lit(False))
    return examples.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), flag.alias("bears")).mapInArrow(run, PACKED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_vector_packing(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents; every token bears loss."""
    packed = pack(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())
    return packed.select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
        "loss_tokens",
    )
