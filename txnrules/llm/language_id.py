"""Language identification with interpolated Kneser-Ney character models.

Letters are lower-cased, everything else becomes one space, and texts start after three pads. Four-gram counts per language
cover every training text but those kept apart for calibration: each task counts its own, Spark adds them up, and all lower orders follow from the
table of distinct four-grams by grouping (continuation counts). Spark also works out the interpolated probability of every n-gram seen in a language, and for each
context the weight of the next lower order, in joins by language and context. An n-gram is known by a 64-bit hash. The model is a file of
sorted arrays of hashes with log-probabilities, a language after the other. It grows with the n-grams and languages of the corpus (12 bytes an n-gram or context;
`Model.size` tells): executors sort and pack the arrays, the driver writes them into the file a packed row at a time, and the workers of a machine share it
memory-mapped. Nothing is pruned.

A text gets, per language, its cross-entropy per character over the whole text; the lowest wins. The score is the winner's
share of exp(-T * cross-entropy). T is fitted by likelihood on at most CALIBRATION training documents, from a tenth of them by
hash; these are not counted. `rejected` says that the winner's cross-entropy is above that of every calibration text of
its language, by more than their deviation.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null language teach nothing, an empty one is a language like others; rows with a null id count as held
out in the query. Repeated rows count as often as they occur. Ties go to the first language by
name. Very long texts are read whole. Other columns are not read. With nothing to learn from every
text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.mapped import Writer, opened
from txnrules.llm.runtime import cut, table

CALIBRATION, FOLDS = 3000, 10
CHARS_AT_ONCE = 1_000_000
RUN = 65_536  # values that are packed into a row
PAD, SPACE = 1, 32
PAD_TEXT = "\ue000" * 3
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
PARTS = ("k4", "p3", "s3", "p2", "s2", "p1", "s1")
GRAMS = "lang string, " + ", ".join(f"{p} long" for p in PARTS) + ", n long"

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to lower-cased letter, space or pad; built once per worker."""
    if not _fold:
        t = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        t[0xE000] = PAD
        _fold.append(t)
    return _fold[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, the positions of those that count, and the text that each of these belongs to."""
    joined = PAD_TEXT + PAD_TEXT.join([t.replace("\ue000", " ") for t in texts])
    f = fold_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    keep = f != SPACE
    keep[1:] |= f[:-1] > SPACE
    f = f[keep]
    pad = f == PAD
    at = np.flatnonzero(~pad)
    return f.astype(np.uint64), at, (np.cumsum(pad)[at] // 3 - 1)


def key(chars: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as n arrays of characters."""
    h = np.full(len(chars[0]), len(chars), np.uint64)
    for c in chars:
        h = h * BASE + c
    h = (h ^ (h >> np.uint64(29))) * SPREAD
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def pieces(texts: list[str]):
    """Slices of texts of about CHARS_AT_ONCE characters; a longer text is a slice of its own."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > CHARS_AT_ONCE:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def four_grams(f: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct four-grams that end at the positions, as four arrays of characters, which of them each position has, and their counts."""
    _, first, which, n = np.unique(key([f[at - k] for k in (3, 2, 1, 0)]), return_index=True, return_inverse=True, return_counts=True)
    return [f[at[first] - k] for k in (3, 2, 1, 0)], which, n


def count_grams(docs: DataFrame) -> DataFrame:
    """docs has lang and text; keys of every four-gram and of its parts, with counts."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for a, b in pieces(mine):
                    f, at, _ = folded(mine[a:b])
                    if len(at):
                        c, _, n = four_grams(f, at)
                        keys = [key(c), key(c[:3]), key(c[1:]), key(c[1:3]), key(c[2:]), key(c[2:3]), key(c[3:])]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *map(pa.array, keys), pa.array(n.astype(np.int64))], ["lang", *PARTS, "n"])

    return docs.select("lang", "text").mapInArrow(run, GRAMS).groupBy("lang", "k4").agg(*[F.min(c).alias(c) for c in PARTS[1:]], F.sum("n").alias("n"))


def interpolated(grams: DataFrame) -> DataFrame:
    """Rows (lang, part, key, value): log-probabilities of the n-grams seen (part g1 to g4), log-weights of contexts (c1 to c4), and the log-floor of unseen letters (f)."""
    n = F.count("*").alias("n")
    four = grams.select("lang", F.col("k4").alias("key"), F.col("p3").alias("ctx"), F.col("s3").alias("low"), "n")
    three = grams.groupBy("lang", F.col("s3").alias("key")).agg(F.min("p2").alias("ctx"), F.min("s2").alias("low"), F.min("p1").alias("ctx2"), F.min("s1").alias("low2"), n)
    two = three.groupBy("lang", F.col("low").alias("key")).agg(F.min("ctx2").alias("ctx"), F.min("low2").alias("low"), n)
    one = two.groupBy("lang", F.col("low").alias("key")).agg(n).select("lang", "key", F.lit(0).cast("long").alias("ctx"), F.lit(0).cast("long").alias("low"), "n")
    floor = cut(one.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("floor")))
    lower, out = None, [floor.select("lang", F.lit("f").alias("part"), F.lit(0).cast("long").alias("key"), F.log("floor").alias("value"))]
    for order, counted in ((1, one), (2, two), (3, three), (4, four)):
        t = cut(counted.select("lang", "key", "ctx", "low", "n"))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = t.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        contexts = cut(t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discounts, "lang").withColumn("weight", F.col("d") * F.col("kinds") / F.col("total")))
        below = floor.select("lang", F.col("floor").alias("p_low")) if lower is None else lower.select("lang", F.col("key").alias("low"), F.col("p").alias("p_low"))
        joined = t.join(contexts, ["lang", "ctx"]).join(below, ["lang"] if lower is None else ["lang", "low"])
        lower = cut(joined.select("lang", "key", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("p_low")).alias("p")))
        out.append(lower.select("lang", F.lit(f"g{order}").alias("part"), "key", F.log("p").alias("value")))
        out.append(contexts.select("lang", F.lit(f"c{order}").alias("part"), F.col("ctx").alias("key"), F.log("weight").alias("value")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


@dataclass
class Model:
    """A shipped file of arrays; per language and part its sorted keys and their values."""

    file: str
    languages: list[str]
    size: int
    temperature: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)

    def log_p(self, chars: list[np.ndarray]) -> np.ndarray:
        """Log-probability of the last character of each four-gram in every language."""
        arrays = opened(self.file)
        grams = [key(chars[4 - k :]) for k in (1, 2, 3, 4)]
        contexts = [np.zeros(len(grams[0]), np.int64), *[key(chars[4 - k : 3]) for k in (2, 3, 4)]]
        out = np.empty((len(self.languages), len(grams[0])))
        for row, lang in zip(out, range(len(self.languages)), strict=True):
            left, weight = np.arange(len(row)), np.zeros(len(row))
            for order in (4, 3, 2, 1):
                hit, value = _found(arrays, f"{lang}/g{order}", grams[order - 1][left])
                row[left[hit]] = weight[hit] + value[hit]
                left, weight = left[~hit], weight[~hit]
                if not len(left):
                    break
                hit, value = _found(arrays, f"{lang}/c{order}", contexts[order - 1][left])
                weight = weight + np.where(hit, value, 0.0)
            row[left] = weight + arrays[f"{lang}/f/value"][0]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text in every language; NaN for a text without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        for a, b in pieces(texts):
            f, at, doc = folded(texts[a:b])
            if not len(at) or not self.languages:
                continue
            n = np.bincount(doc, minlength=b - a)
            chars, which, _ = four_grams(f, at)
            total = np.array([np.bincount(doc, row[which], b - a) for row in self.log_p(chars)]).T
            some = n > 0
            out[a:b][some] = -total[some] / n[some, None]
        return out

    def calibrate(self, e: np.ndarray, truth: np.ndarray) -> None:
        """e: entropies of texts, truth: places of their languages."""
        if len(e):
            grid = np.geomspace(0.5, 200, 60)
            self.temperature = float(grid[np.argmin([-np.log(np.maximum(shares(e, t)[np.arange(len(e)), truth], 1e-9)).mean() for t in grid])])
        for k, lang in enumerate(self.languages):
            own = e[truth == k, k]
            self.limits[lang] = float(own.max() + own.std()) if len(own) else float("inf")

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), [False] * len(texts)
        e = self.entropies(texts)
        none = np.isnan(e[:, 0])
        best = np.where(none, 0, np.argmin(np.where(np.isnan(e), np.inf, e), axis=1))
        score = np.where(none, 0.0, np.nan_to_num(shares(e, self.temperature))[np.arange(len(e)), best])
        langs = ["und" if n else self.languages[b] for n, b in zip(none, best, strict=True)]
        return langs, score, [not n and x[b] > self.limits.get(self.languages[b], np.inf) for n, x, b in zip(none, e, best, strict=True)]


def _found(arrays: dict[str, np.ndarray], name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = arrays[f"{name}/key"]
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, arrays[f"{name}/value"][place]


def shares(e: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (e - e.min(axis=1, keepdims=True))
    return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)


def _add_sorted(writer: Writer, values: DataFrame, languages: list[str]) -> None:
    """Adds the arrays of all languages and parts. Executors sort the values by language, part and key and pack RUN of them into a row; the driver appends one
    row after the other to the file and holds a few of them at a time, whatever their number."""
    numbers = {x: k for k, x in enumerate(languages)}

    def pack(batches):
        for batch in batches:
            number, part = np.array([numbers[x] for x in batch.column(0).to_pylist()]), np.array(batch.column(1).to_pylist())
            keys, value = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ends = np.flatnonzero((number[1:] != number[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *ends], [*ends, len(keys)], strict=True):
                for c in range(a, b, RUN):
                    d = min(b, c + RUN)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{number[c]}/{part[c]}"]), pa.array([keys[c:d].tobytes()]), pa.array([value[c:d].tobytes()])], ["name", "keys", "values"])

    flat = values.select("lang", "part", "key", F.col("value").cast("float").alias("value"))
    packed = cut(flat.repartitionByRange("lang", "part", "key").sortWithinPartitions("lang", "part", "key").mapInArrow(pack, "name string, keys binary, values binary").withColumn("place", F.monotonically_increasing_id()))
    for column, kind in (("keys", np.int64), ("values", np.float32)):
        rows = packed.select("place", "name", column).orderBy("place").toLocalIterator()  # in order of language, part and key
        for name, own in itertools.groupby(rows, key=lambda r: r["name"]):
            writer.add_parts(f"{name}/{column[:-1]}", (np.frombuffer(r[column], kind) for r in own), kind)
    for name in (f"{k}/{p}" for k in range(len(languages)) for p in ("f", *[f"{x}{order}" for order in (1, 2, 3, 4) for x in "gc"])):
        if f"{name}/key" not in writer.head:
            writer.add(f"{name}/key", np.zeros(0, np.int64))
            writer.add(f"{name}/value", np.zeros(0, np.float32))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", calibration: int = CALIBRATION) -> Model:
    """Learn from every row with a text and a language."""
    spark = docs.sparkSession
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64(key, F.lit("calibration")).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    fold = F.pmod("h", F.lit(FOLDS)) == 0
    last = known.filter(fold).select("h").orderBy("h").limit(calibration).agg(F.max("h")).first()[0]
    apart = fold & (F.col("h") <= (last if last is not None else -(2**63)))
    grams = cut(count_grams(known.filter(~apart)))
    languages = sorted(r.lang for r in grams.select("lang").distinct().collect())
    writer = Writer("languages")
    values = cut(interpolated(grams))
    if languages:
        _add_sorted(writer, values, languages)
    model = Model(writer.ship(spark), languages, writer.size)
    place = {x: k for k, x in enumerate(languages)}

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            e = model.entropies(batch.column(0).to_pylist())
            good = [k for k, x in enumerate(langs) if x in place and not np.isnan(e[k, 0])]
            yield pa.RecordBatch.from_arrays([pa.array([place[langs[k]] for k in good], pa.int32()), pa.array([e[k].tolist() for k in good], pa.list_(pa.float64()))], ["truth", "e"])

    if languages:
        told = known.filter(apart).select("text", "lang").mapInArrow(run, "truth int, e array<double>").collect()
        model.calibrate(np.array([r.e for r in told]).reshape(len(told), len(languages)), np.array([r.truth for r in told], int))
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, lang_pred, score, rejected."""

    def run(batches):
        for batch in batches:
            langs, score, rejected = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, lang_pred string, score double, rejected boolean")


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """All documents, with models learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs, model)
    return found.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score", "rejected")
