"""What several operators share: scratch tables, row keys, packed record exchange, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text behind one hash bucket or one group of documents: small while that gives few groups, then the larger.
SMALL_GROUP, GROUP_BYTES, FEW_GROUPS = 2 << 20, 16 << 20, 4096
#: Rows of ids and hashes that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that are compressed together for their groups.
PACKED_BYTES = 16 << 20
#: Upper bound of hash buckets; beyond it the buckets grow instead (at 100 TB: the anchors of about 400 MB of text each).
MAX_BUCKETS = 1 << 18


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, a temporary folder is set in local mode (tests) only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: later jobs neither recompute nor lose them."""
    path = scratch(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rested(spark: SparkSession) -> None:
    """Executors collect their garbage, and so give back to the system what a stage made their heap grow to, before another stage's workers need it.

    A task for each core asks its JVM; requests that meet in a JVM are one collection. Nothing depends on every executor being reached.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("asked")).write.format("noop").mode("overwrite").save()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(doc_id, k, first, text) with k a unique bigint in the order of doc_id, first the smallest k of the doc_id; carried columns follow as
    x0, x1, ... Also whether rows share a doc_id or have none.

    Where they don't, k and first are the doc_id. Otherwise the rows are ordered by doc_id (nulls last), then by a hash of
    the text, numbered, and written once, so that each row is a document of its own.
    """
    rest = [F.col(c).alias(f"x{i}") for i, c in enumerate(carried)]
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    names = ["doc_id", "k", "first", "text", *(f"x{i}" for i in range(len(carried)))]
    several = d.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("of"))
    if several.limit(1).isEmpty():
        return d.withColumns({"k": F.col("doc_id"), "first": F.col("doc_id")}).select(*names), False
    d = d.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text").withColumn("k", F.monotonically_increasing_id())
    d = stored(d, "keyed")
    least = d.join(several, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").groupBy(F.col("doc_id").alias("of")).agg(F.min("k").alias("least"))
    d = d.join(stored(least, "least"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return d.withColumn("first", F.coalesce("least", "k")).select(*names), True


def text_key() -> Column:
    """Hash of a text; with the doc_id it tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, of_text; written already), with the columns they came with, whatever their names."""
    ids, of_text = (f"_{uuid.uuid4().hex}" for _ in range(2))  # no column of docs has such a name
    gone = rows.select(F.col("doc_id").alias(ids), F.col("of_text").alias(of_text)).distinct()
    gone = F.broadcast(gone) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col(ids)) & (text_key() == F.col(of_text)), "left_anti")


def with_group(rows: DataFrame, groups: DataFrame, key: str, n: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the group that they belong to (nulls are a key too). groups: key (one row each), n (rows of it) and columns.

    Groups beyond a counted bound meet their rows by shuffle, but for those with a thousandth of the rows or more: these are a thousand at most, and
    are broadcast, so that no task gathers the rows of a common key.
    """
    own = f"_{uuid.uuid4().hex}"
    g = groups.select(F.col(key).alias(own), F.col(n).alias(f"{own}n"), *columns)
    joined = lambda r, g: r.join(g.drop(f"{own}n"), F.col(key).eqNullSafe(F.col(own)), "left").drop(own)
    if g.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return joined(rows, F.broadcast(g))
    total = groups.agg(F.sum(n).alias("n")).first()["n"]
    is_hot = F.col(f"{own}n") * 1000 >= total
    hot = F.broadcast(g.where(is_hot))
    common = rows.join(hot, F.col(key).eqNullSafe(F.col(own)), "left_semi")
    others = rows.join(hot, F.col(key).eqNullSafe(F.col(own)), "left_anti")
    return joined(common, hot).unionByName(joined(others, g.where(~is_hot)))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def group_counts(total: int) -> tuple[int, int]:
    """How many hash buckets and how many groups of documents suit so many bytes of text."""
    groups = max(1, min(FEW_GROUPS, -(-total // SMALL_GROUP)), -(-total // GROUP_BYTES))
    return min(MAX_BUCKETS, groups), groups


def bucket_column(k, n: int):
    """The text group of a row; `bucket_of` is the same function for arrays."""
    return F.pmod(F.hash(k), F.lit(n)).cast("int")


def bucket_of(k: np.ndarray, n: int) -> np.ndarray:
    """Spark's hash() of bigints, modulo n."""
    u = k.astype(np.int64).view(np.uint64)
    h = np.full(len(u), 42, np.uint32)
    for part in ((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
        x = part * np.uint32(0xCC9E2D51)
        x = ((x << np.uint32(15)) | (x >> np.uint32(17))) * np.uint32(0x1B873593)
        h ^= x
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    return np.mod(h.view(np.int32).astype(np.int64), n)


# --- records packed by bucket -------------------------------------------------------------------------------

def pack(rec: np.ndarray) -> bytes:
    """Bytes of a record array, one plane per byte of the record: planes that hardly vary compress to nothing."""
    return rec.view(np.uint8).reshape(len(rec), rec.dtype.itemsize).T.tobytes()


def unpack(blobs: list, dtype: np.dtype) -> np.ndarray:
    parts = []
    for b in blobs:
        a = np.frombuffer(b, np.uint8).reshape(dtype.itemsize, -1)
        parts.append(np.ascontiguousarray(a.T).reshape(-1).view(dtype))
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def dealt(rec: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Records dealt out by bucket: the buckets that have any, and their packed records."""
    if not len(rec):
        return [], []
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    rec = rec[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.r_[cut[1:], len(b)]
    return b[cut].astype(int).tolist(), [pack(rec[s:e]) for s, e in zip(cut, ends, strict=True)]


#: kind 0: records that meet by hash in bucket b. kind 1: what is known, for the documents of group `to`; it passes through a bucket on its way.
BLOB_SCHEMA = "kind int, b int, to int, blob binary"


def blob_batch(kind: int, rec: np.ndarray, bucket: np.ndarray, n: int = 1 << 30) -> pa.RecordBatch:
    ids, blobs = dealt(rec, bucket)
    columns = [pa.array([kind] * len(ids), pa.int32()), pa.array([i % n for i in ids], pa.int32()), pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "b", "to", "blob"])


def kind_of(group: pa.Table, kind: int) -> pa.Table:
    return group.filter(pc.equal(group["kind"], kind))


# --- rolling hashes over arrays -------------------------------------------------------------------------------

class Rolling:
    """Polynomial hashes modulo 2^64 of slices of an array; equal slices have equal hashes wherever they stand."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**61, 2**62)) * 4 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)])])

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, for sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def split_by_repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that occur more than once, and of the others."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    again = same[1:] | same[:-1]
    return order[again], order[~again]


def arrow_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each value begins (one more at the end)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.string())
    a = a.fill_null("")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def release() -> None:
    """Freed memory goes back to the system; workers are used again, for work of another kind."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(f):
    """A function of batches that gives its memory back when it ends."""

    def of(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return of


def pieces(table: pa.RecordBatch | pa.Table, column: str, limit: int):
    """Slices of a batch with about `limit` bytes of text each; a longer row stands alone."""
    _, off = arrow_text(table.column(column))
    start = 0
    while start < table.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield table.slice(start, end - start)
        start = end


def slices(batches, column: str, limit: int):
    """Batches of about `limit` bytes of text from batches of any size; a longer row stands alone."""
    held, size = [], 0
    together = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        n = len(arrow_text(batch.column(column))[0])
        if held and size + n > limit:
            yield together()
            held, size = [], 0
        if n > limit:
            yield from pieces(batch, column, limit)
        elif batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield together()


# --- connected components ------------------------------------------------------------------------------------

def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    edges: (a, b) bigint. Alternating large-star and small-star rounds; minima are pre-aggregated and joined
    back, so the neighbours of a hub are never gathered. Each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# --- texts dealt to groups -------------------------------------------------------------------------------------

def dealt_text(docs: DataFrame, size: int = PACKED_BYTES) -> DataFrame:
    """(to, blob): the rows of docs (doc_id, k, text, to and more), compressed together for each group and slice of `size` bytes.

    Fewer and smaller shuffle records than a row per document; `text_of` gives the rows of a group.
    """
    names = [c for c in docs.columns if c != "to"]

    def packed(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in slices(batches, "text", size):
            to = batch.column("to").to_numpy()
            order = np.argsort(to, kind="stable")
            rows = pa.Table.from_batches([batch.select(names)]).take(pa.array(order))
            to = to[order]
            cut = runs(to)
            blobs = []
            for s, e in zip(cut, np.r_[cut[1:], len(to)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_table(rows.slice(s, e - s))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array(blobs, pa.binary())], names=["to", "blob"])

    return docs.select("to", *names).mapInArrow(releasing(packed), "to int, blob binary")


def text_of(group: pa.Table) -> pa.Table:
    """The rows of a group of `dealt_text`: doc_id, k, text and what came with them."""
    release()
    tables = [pa.ipc.open_stream(b).read_all() for b in group["blob"].to_pylist()]
    if not tables:
        return pa.table({"doc_id": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    return pa.concat_tables(tables).combine_chunks()
