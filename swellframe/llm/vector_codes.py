"""Vector codes: integer product codebooks, refined over all vectors; the nearest entry is found by slices and bitmasks.

Vectors become integers (floor of `scale` times a component) and are cut into parts; each part position has a codebook. A round assigns every
vector's parts to their nearest entries and moves the entries to the floored means.

The nearest entry of a codebook of at most 64: for each dimension the entries are sorted by coordinate, and prefix masks say which are
among the first i of them. A part's distance to one entry (that whose coordinate sum is next to its own) is the initial radius. In each
dimension two binary searches cut the slice of entries within that radius, and the XOR of two prefix masks is the slice as 64 bits; the AND over the
dimensions leaves the entries of the box around the part, which holds the nearest. Exact integer distances decide among these, ties to the lower
index.

Each round reads the integers (written once) and shuffles the sums of each task, a row per part, entry and dimension; codebooks, whose size the parameters
bound, go through the driver. Sums of labels are pre-aggregated and joined back by `with_group`, so that a common label is split.

Defined results: vectors that are null or empty, or hold a null or non-finite component or one whose integer exceeds 64 bits, are dropped, and
so are those whose length is not the commonest (of equals the longer). If parts don't divide the length, they differ by one in width. Rows that repeat a vec_id or have none
are vectors of their own; the first entries are ordered by vec_id (nulls last), then by components. Fewer vectors than entries give as many
entries. An error beyond 64 bits is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored, with_group

#: Vectors that are worked on at once.
SLICE_ROWS = 4096
SUMS = "part int, entry int, dim int, total decimal(38,0), n bigint"


class Codebook:
    """Entries (rows of integers, 64 at most) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        self.sorted, self.prefix = [], []
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            self.sorted.append(entries[order, d])
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[order])]))
        sums = entries.sum(axis=1) if width else np.zeros(n, np.int64)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def distance(self, x: np.ndarray, entry) -> np.ndarray:
        d = x - self.entries[entry]
        return (d * d).sum(axis=1) if d.shape[1] else np.zeros(len(x), np.int64)

    def candidates(self, x: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Masks of the entries in the box around each row that holds all within the squared radius."""
        root = np.sqrt(square).astype(np.int64) + 1 if square.dtype != object else np.frompyfunc(math.isqrt, 1, 1)(square) + 1
        mask = np.full(len(x), ~np.uint64(0))
        for d, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(coordinates, x[:, d] - root, "left")
            high = np.searchsorted(coordinates, x[:, d] + root, "right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest on a tie, and the squared distance."""
        own = x.sum(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.sums, own), len(self.sums) - 1)
        below = np.maximum(at - 1, 0)
        seed = self.by_sum[np.where(np.abs(self.sums[below] - own) <= np.abs(self.sums[at] - own), below, at)]
        best, square = seed.copy(), self.distance(x, seed)
        mask = self.candidates(x, square)
        for j in range(len(self.entries)):
            rows = np.flatnonzero(((mask >> np.uint64(j)) & np.uint64(1)).astype(bool) & (seed != j))
            d = self.distance(x[rows], j)
            nearer = (d < square[rows]) | ((d == square[rows]) & (j < best[rows]))
            rows = rows[nearer.astype(bool)]
            best[rows], square[rows] = j, d[nearer.astype(bool)]
        return best, square


def integers(vectors: DataFrame, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q (the integer components, 64 bits each), top (the largest of their absolute values) of the usable vectors, written once."""

    def of(batches):
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            v = batch.column("v")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # nulls are NaN
            row = np.repeat(np.arange(len(size)), size)
            ok = size > 0
            ok[row[~(np.abs(x) < 2.0**63)]] = False
            q = x[ok[row]].astype("<i8")
            size = size[ok]
            end = np.cumsum(size)
            top = np.maximum.reduceat(np.abs(q), end - size) if len(q) else np.empty(0, np.int64)
            kept = batch.filter(pa.array(ok))
            blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.r_[0, end] * 8).astype(np.int32).tobytes()), pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), blobs, pa.array(top, pa.int64())], names=["vec_id", "label", "q", "top"])

    label = dict(vectors.dtypes)[label_col]
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    made = stored(rows.mapInArrow(releasing(of), f"vec_id bigint, label {label}, q binary, top bigint"), "integers")
    sizes = made.groupBy(F.octet_length("q").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()["size"]
    return made.where(F.octet_length("q") == F.lit(usual))


def _matrix(q: pa.Array, wide: bool) -> np.ndarray:
    """The integers of a binary column whose values have one length; as Python integers where products would exceed 64 bits."""
    a = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    data = b"".join(a.to_pylist())
    x = np.frombuffer(data, "<i8").reshape(len(a), -1)
    return x.astype(object) if wide else x


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


class Codec:
    """Codebooks of all part positions and the codes of vectors."""

    def __init__(self, books: list[np.ndarray], width: int, wide: bool):
        self.cuts, self.wide = bounds(width, len(books)), wide
        self.books = [Codebook(b.astype(object) if wide else b.astype(np.int64)) for b in books]

    def parts(self, batches, column: str):
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            x = _matrix(batch.column(column), self.wide)
            yield batch, [x[:, a:b] for a, b in self.cuts]


def refined(table: DataFrame, books: list[np.ndarray], width: int, wide: bool) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts that are nearest to each entry; entries without any stay."""
    codec = Codec(books, width, wide)

    def summed(batches):
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for _, xs in codec.parts(batches, "q"):
            for p, x in enumerate(xs):
                nearest, _ = codec.books[p].nearest(x)
                for j in np.unique(nearest):
                    rows = x[nearest == j]
                    count[p][j] += len(rows)
                    total[p][j] += rows.sum(axis=0)
        out = [(p, j, d, Decimal(int(total[p][j, d])), int(count[p][j])) for p in range(len(books)) for j in np.flatnonzero(count[p]).tolist() for d in range(total[p].shape[1])]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, types, strict=True)], names=["part", "entry", "dim", "total", "n"])

    sums = table.select("q").mapInArrow(releasing(summed), SUMS).groupBy("part", "entry", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = [b.astype(object) for b in books]
    for r in sums.collect():  # at most parts * entries * dimensions of a part
        new[r["part"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return new


def fitted(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[np.ndarray], int, bool]:
    """Codebooks from the rows of `integers`, the length of a vector, and whether products may exceed 64 bits; no codebooks without vectors."""
    if not 0 < entries <= 64:
        raise ValueError("a mask has 64 bits: 1 to 64 entries")
    numbers = lambda q: np.frombuffer(q, "<i8").tolist()
    first = table.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries)
    first = [numbers(bytes(r["q"])) for r in first.collect()]
    if not first:
        return [], 0, False
    width = len(first[0])
    wide = 4 * table.agg(F.max("top").alias("top")).first()["top"] ** 2 * width >= 2**62
    books = [np.array([v[a:b] for v in first], object).reshape(len(first), b - a) for a, b in bounds(width, parts)]
    for _ in range(rounds):
        books = refined(table, books, width, wide)
    return books, width, wide


def encoded(table: DataFrame, books: list[np.ndarray], width: int, wide: bool) -> DataFrame:
    """vec_id, label, codes (a byte for each part), error (squared distances summed over parts)."""
    codec = Codec(books, width, wide)

    def of(batches):
        for batch, xs in codec.parts(batches, "q"):
            found = [codec.books[p].nearest(x) for p, x in enumerate(xs)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum((f[1].astype(object) if wide else f[1]) for f in found)
            error = [e if e < 2**63 else None for e in error.tolist()]
            codes = [row.tobytes() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    label = dict(table.dtypes)["label"]
    return table.select("vec_id", "label", "q").mapInArrow(releasing(of), f"vec_id bigint, label {label}, codes binary, error bigint")


def listed(books: list[np.ndarray]) -> str:
    """All components of all entries, by part, entry and position."""
    return ",".join(str(int(x)) for b in books for entry in b for x in entry)


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, codes, error, label_error (error summed over the rows of the label), and the codebooks."""
    table = integers(vectors, scale, id_col, vector_col, label_col)
    books, width, wide = fitted(table, parts, entries, rounds)
    if not books:
        empty = table.select("vec_id", "label", F.col("q").alias("codes"), F.lit(0).cast("bigint").alias("error")).limit(0)
        return empty.withColumn("label_error", F.lit(0).cast("bigint")), books
    rows = stored(encoded(table, books, width, wide), "codes")
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error"))
    return with_group(rows, stored(labels, "labels"), "label", "n", ["label_error"]), books


def digests(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256."""
    rows, books = compressed(vectors, **parameters)
    sha = hashlib.sha256(listed(books).encode()).hexdigest()
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    near = lambda k: (
        f"a{k} as materialized (select p, vec_id, any_value(label) label, any_value(v) v, min(d * {entries} + j) % {entries} j, min(d * {entries} + j) // {entries} d from (select t.*, c.j, list_sum(list_transform(range(1, len(t.v) + 1), lambda i: (t.v[i] - c.v[i]) * (t.v[i] - c.v[i])))::bigint d from pts t join c{k} c using (p)) group by p, vec_id)"
    )
    move = lambda k: (
        f"m{k} as materialized (select p, j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) v from (select p, j, i, sum(x) s, count(*) n from (select p, j, unnest(v) x, unnest(range(1, len(v) + 1)) i from a{k}) group by p, j, i) group by p, j), "
        f"c{k + 1} as materialized (select c.p, c.j, coalesce(m.v, c.v) v from c{k} c left join m{k} m using (p, j))"
    )
    return (
        f"with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale}.0::double * x::double)::bigint) q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: coalesce(not isfinite(x), true))) = 0), "
        f"pts as materialized (select vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] v from kept, range({parts}) r(p)), "
        f"c0 as materialized (select p, j, v from pts join (select vec_id, row_number() over (order by vec_id) - 1 j from kept qualify j < {entries}) using (vec_id)), "
        + ", ".join(f"{near(k)}, {move(k)}" for k in range(rounds))
        + f", {near(rounds)}, s as (select sha256(string_agg(x::varchar, ',' order by p, j, i)) codebooks_sha256 from (select p, j, unnest(v) x, unnest(range(1, len(v) + 1)) i from c{rounds})), "
        f"o as (select vec_id, any_value(label) label, string_agg(lower(printf('%02x', j)), '' order by p) code, sum(d)::bigint error from a{rounds} group by vec_id), l as (select label, sum(error)::bigint label_error from o group by label) "
        "select vec_id, code, error, label_error, codebooks_sha256 from o join l on o.label is not distinct from l.label, s"
    )


SQL = _sql()
