"""Whitening of embeddings from exact bit-sliced cross-products.

An entry c counts as the integer x = floor(SCALE * c) + OFFSET. A task packs the bit planes of each dimension, shifted by the least x of its block, across BLOCK rows into 64-bit
words; the weighted population counts of the ANDs of two planes add up to the exact cross-product of two dimensions. Spark adds up cross-products and sums,
which are DIM * (DIM + 3) / 2 numbers whatever the number of rows; the driver centres them as integers (n * sum of x_d * x_e - S_d * S_e) and only then divides, so
the covariance is that of centred values, rounded once. Its eigenvectors, largest eigenvalue first, signed so that their largest entry is positive, go to every
task as COMPONENTS x DIM numbers. Whitened is (x - S / n) projected on an eigenvector, over the root of its eigenvalue; a second scan adds up whitened values and their products
for the identity error, a third one writes the result. No row is shuffled.

Nulls: rows whose vector is null or has a null or non-finite entry are dropped. All vectors are to have one length: the commonest one among the vectors that are not null, the longer one of
two; rows of another length, empty ones included, are dropped as well. An entry that no long can hold counts as the nearest that one can, less the offset. Null ids are kept, and repeated
rows are each fitted and returned. Equal eigenvalues have some orthonormal vectors. A component whose eigenvalue is 0 to double precision
(constant dimensions, copies of one vector, fewer rows than components) has null whitened values and is left out of the identity error, which is null if all are. A deviation beyond a long is null:
with 64 dimensions that spread over 300 it is reached at some 1e6 rows. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import table

SCALE, OFFSET = 1024, 100_000
BLOCK = 16_384  # rows whose planes are packed together
COMPONENTS = 8
LARGEST = 2**62
TOTALS = "d int, e int, value decimal(38,0)"
WHITENED = "key long, component int, n long, deviation long, whitened double, explained double"


def integers(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x) of the vectors that count: a row of `dim` integers each."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    right = (sizes == dim) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    values = pa.array(vectors.filter(pa.array(right)).flatten()).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[finite] * SCALE)
    return np.flatnonzero(right)[finite], np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of a block's non-negative integers (rows x dimensions), packed across rows into words; the dimension and the bit of each plane."""
    widths = [int(m).bit_length() for m in y.max(axis=0)]
    dims = np.repeat(np.arange(y.shape[1]), widths)
    bits = np.concatenate([np.arange(w) for w in widths]).astype(np.uint64)
    rows = -(-len(y) // 64) * 64
    planes = np.zeros((len(dims), rows // 8), np.uint8)
    columns = np.ascontiguousarray(y.T)
    for k, (d, p) in enumerate(zip(dims.tolist(), bits, strict=True)):
        packed = np.packbits((columns[d] >> p & np.uint64(1)).astype(np.uint8))
        planes[k, : len(packed)] = packed
    return planes.view(np.uint64), dims, bits.astype(np.int64)


def sliced_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (dimension) and cross-products (dimension x dimension) of a block, as Python integers."""
    planes, dims, bits = bit_planes(y)
    dim, count = y.shape[1], len(dims)
    common = np.zeros((count, count), np.int64)
    for k in range(count):
        common[k, k:] = common[k:, k] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    if not count:
        return sums, products
    some, first = np.unique(dims, return_index=True)
    small = 2 * (int(bits.max()) + 1) + len(y).bit_length() < 62
    weight = np.left_shift(np.int64(1), bits) if small else np.array([1 << int(b) for b in bits], object)
    cross = np.add.reduceat(np.add.reduceat(common * weight[:, None] * weight, first, axis=0), first, axis=1)
    sums[some] = np.add.reduceat(common.diagonal() * weight, first).astype(object)
    products[np.ix_(some, some)] = cross.astype(object)
    return sums, products


def block_totals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of unshifted integers."""
    least = x.min(axis=0)
    shift, n = least.astype(object), len(x)
    sums, products = sliced_products((x - least).view(np.uint64))
    return sums + n * shift, products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)


@dataclass
class Whitening:
    """n vectors of `dim` entries with sums S; eigenvalues, largest first, and their unit vectors as rows."""

    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is not 0."""
        return self.values > 1e-12 * max(float(self.values[0]), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs, or Python integers where longs may not do."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if most < LARGEST else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; None beyond a long."""
        if centred.dtype != object and self.dim * int(np.abs(centred).max(initial=0)) ** 2 < 2**63:
            return (centred * centred).sum(axis=1).tolist()
        sums = [sum(v * v for v in row) for row in centred.tolist()]
        return [s if s < 2**63 else None for s in sums]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values, a column per component; NaN where the eigenvalue is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (centred / self.n).astype(float) @ self.vectors.T * scale


def dimension(df: DataFrame, column: str) -> int:
    """The commonest length of a vector, the longer one of two; 0 if there is none."""
    sizes = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).filter("size > 0")
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def totals(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows (d, e, value) of one each: the number of vectors (-1, -1), the sums (-1, d) and the cross-products (d, e) for d <= e."""

    def run(batches):
        held, rows, n = [], 0, 0
        sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)

        def blocks(last):
            nonlocal held, rows
            while rows >= BLOCK or (last and rows):
                x = np.concatenate(held)
                held, rows = [x[BLOCK:]], max(0, rows - BLOCK)
                yield x[:BLOCK]

        for batch in [*batches, None]:
            if batch is not None:
                x = integers(batch.column(0), dim)[1]
                held.append(x)
                rows += len(x)
            for x in blocks(batch is None):
                more, cross = block_totals(x)
                sums, products, n = sums + more, products + cross, n + len(x)
        if n:
            d, e = np.triu_indices(dim)
            at = [np.concatenate([[-1], np.full(dim, -1), d]), np.concatenate([[-1], np.arange(dim), e])]
            values = [Decimal(v) for v in [n, *sums, *products[d, e]]]
            yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in at], pa.array(values, pa.decimal128(38, 0))], ["d", "e", "value"])

    return df.select(column).mapInArrow(run, TOTALS).groupBy("d", "e").agg(F.sum("value").alias("value"))


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None if no vector counts."""
    dim = dimension(df, column)
    found = {(r.d, r.e): int(r.value) for r in totals(df, column, dim).collect()} if dim else {}  # dim * (dim + 3) / 2 rows
    if not found:
        return None
    n, sums = found[-1, -1], [found[-1, d] for d in range(dim)]
    covariance = np.zeros((dim, dim))
    for d in range(dim):
        for e in range(d, dim):
            covariance[d, e] = covariance[e, d] = (n * found[d, e] - sums[d] * sums[e]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    trace = float(np.trace(covariance))
    return Whitening(n, dim, sums, values, vectors, values / trace if trace else np.zeros(len(values)))


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from the whitened vectors themselves."""
    some = np.flatnonzero(model.usable)

    def run(batches):
        moments = np.zeros((len(some) + 1, len(some)))
        for batch in batches:
            w = model.project(model.centred(integers(batch.column(0), model.dim)[1]))[:, some]
            moments[0] += w.sum(axis=0)
            moments[1:] += w.T @ w
        place = np.indices(moments.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.array(moments.ravel())], ["d", "e", "value"])

    if not len(some):
        return None
    found = np.zeros((len(some) + 1, len(some)))
    for r in df.select(column).mapInArrow(run, "d int, e int, value double").groupBy("d", "e").agg(F.sum("value").alias("value")).collect():  # at most 9 x 8 rows
        found[r.d, r.e] = r.value / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(len(some))).max())


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per vector that counts and component: key, component (from 1), n, deviation, whitened, explained."""

    def run(batches):
        many = len(model.values)
        for batch in batches:
            place, x = integers(batch.column(1), model.dim)
            centred = model.centred(x)
            whitened = model.project(centred)
            columns = [
                batch.column(0).take(pa.array(np.repeat(place, many))),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * many, model.n)),
                pa.array([d for d in model.deviations(centred) for _ in range(many)], pa.int64()),
                pa.array(whitened.ravel(), mask=np.isnan(whitened.ravel())),
                pa.array(np.tile(model.explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(column).alias("vector")).mapInArrow(run, WHITENED)


def op12_bit_sliced_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], WHITENED.replace("key", "vec_id") + ", identity_error double")
    return whiten(vectors, model).withColumnRenamed("key", "vec_id").withColumn("identity_error", F.lit(identity_error(vectors, model)).cast("double"))
