"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame expressions only.

An item is in a document if the document has at least `share` of the item's distinct word shingles. Documents are
much longer than items, so resemblance says nothing; containment needs another sketch. Items are partitioned by the
size of their shingle sets (powers of two). In a partition of sets of at most u shingles, an item's sketch is the
bottom k = u - ceil(share * u) + 1 of its shingles by hash (MinHash order), or all of them: a document that
has `share` of the item misses at most u - ceil(share * u), so it has one of the sketch. The search loses nothing.

Probing: document words are exploded and joined by the first word of the sketch shingles; only where a first word
fits is the shingle hashed. Candidates are verified by the exact sets. Sketches and candidates are broadcast only
under a counted bound. Beyond it, hashes of shingles (64 bits, then 128) meet the sketches, and the shingles of candidate items, by shuffle: a few bytes for each, never
texts or words; skew joins split hot ones.

Text: A-Z lower-cased, words are runs of other than space and bytes 9 to 13, shingles of five words; an item with fewer words is
one shingle. Defined results: null or blank texts have no shingles and match nothing; rows that repeat an id count
as the best of them; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key, without_rows

#: Rows (of a few dozen bytes to a few hundred) up to which a side is broadcast.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")


def shingles(w: Column, n: Column) -> Column:
    """Distinct runs of n words, joined by a space; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    return F.when((F.size(w) >= n) & (n > 0), F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def hashed(n: int) -> Column:
    """An array of (w, h, g), a length and two hashes, of the shingles of n words of ws."""
    return F.transform(shingles(F.col("ws"), F.lit(n)), lambda s: F.struct(F.lit(n).alias("w"), F.xxhash64(s).alias("h"), F.xxhash64(s, F.lit(1)).alias("g")))


def hashes_of(d: DataFrame, items: DataFrame) -> DataFrame:
    """row (a number), doc_id, w, h, g: a row per distinct shingle of a document's row, for each shingle length that items have."""
    lengths = [r["w"] for r in items.select("w").distinct().collect()]  # 1 to shingle
    each = F.concat(*(hashed(w) for w in lengths)) if lengths else F.array().cast("array<struct<w:int,h:bigint,g:bigint>>")
    rows = d.withColumn("row", F.monotonically_increasing_id())  # before it is exploded
    return rows.select("row", "doc_id", F.inline(each))


def small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def item_sketches(benchmark: DataFrame, share: float, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """item_id, w (words of a shingle), sh (all distinct shingles), n, size_class, sketch (the bottom k of them)."""
    b = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("ws"))
    b = b.withColumn("w", F.least(F.size("ws"), F.lit(shingle))).withColumn("sh", shingles(F.col("ws"), F.col("w")))
    b = b.where(F.size("sh") > 0).withColumn("n", F.size("sh")).withColumn("size_class", F.ceil(F.log2("n")).cast("int"))
    bound = F.pow(F.lit(2.0), F.col("size_class"))
    k = (bound - F.ceil(F.lit(share) * bound - 1e-9) + 1).cast("int")
    order = F.array_sort(F.transform("sh", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    return b.withColumn("sketch", F.slice(order, 1, k)).drop("ws")


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of every document and item with containment >= share."""
    items = stored(item_sketches(benchmark, share, shingle, item_col, item_text_col), "items")
    sketch = items.select("item_id", "w", F.explode("sketch").alias("e")).select("item_id", "w", F.col("e.h").alias("h"), F.substring_index("e.s", " ", 1).alias("first_word"))
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))

    if small(sketch):
        probe = d.select("doc_id", "ws", F.posexplode("ws").alias("at", "word"))
        same = F.xxhash64(F.array_join(F.slice("ws", F.col("at") + 1, F.col("w")), " ")).bitwiseXOR(F.col("h")) == 0
        found = probe.join(F.broadcast(sketch), F.col("word") == F.col("first_word")).where(same)
    else:
        found = hashes_of(d, items).join(sketch.select("item_id", "w", "h").hint("shuffle_hash"), ["w", "h"])
    candidates = stored(found.select("doc_id", "item_id").distinct(), "candidates")

    wanted = candidates.withColumnRenamed("doc_id", "id")
    if small(candidates) and small(items):
        pairs = d.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
        pairs = pairs.join(F.broadcast(items.select(F.col("item_id").alias("item"), "w", "sh", "n")), F.col("item_id").eqNullSafe(F.col("item")))
        shared = F.size(F.array_intersect("sh", shingles(F.col("ws"), F.col("w"))))
    else:
        pairs = hashes_of(d, items).join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
        own = items.select(F.col("item_id").alias("item"), F.col("w").alias("v"), "n", F.explode("sh").alias("s")).select("item", "v", "n", F.xxhash64("s").alias("x"), F.xxhash64("s", F.lit(1)).alias("y"))
        pairs = pairs.join(own, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("w") == F.col("v")) & (F.col("h") == F.col("x")) & (F.col("g") == F.col("y")))
        pairs = pairs.groupBy("row", "doc_id", "item_id", "n").agg(F.count("*").alias("c"))
        shared = F.col("c")
    pairs = pairs.select("doc_id", "item_id", F.col("n").cast("bigint").alias("item_shingles"), shared.cast("bigint").alias("shared_shingles"))
    pairs = pairs.where(F.col("shared_shingles") >= F.lit(share) * F.col("item_shingles") - 1e-9)
    pairs = pairs.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles"))
    return pairs.withColumn("containment", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6))


def without_contained(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """The documents that contain no item, with the columns they came with. Rows go one by one: those that share a doc_id, or have none, are
    told apart by their texts."""
    rows = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("of_text")).alias("row"), "text")
    bad = contained_items(rows, benchmark, share, id_col="row").select("doc_id.*").distinct()
    return without_rows(docs, stored(bad, "contained"))


_SQL_WORDS = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
with i as (select item_id, {_SQL_WORDS} ws from benchmark),
ish as (select item_id, least(len(ws), 5) w, list_distinct(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda p: array_to_string(ws[p : p + least(len(ws), 5) - 1], ' '))) sh from i where len(ws) > 0),
d as (select doc_id, {_SQL_WORDS} ws from documents),
dsh as (select distinct doc_id, w, array_to_string(ws[p : p + w - 1], ' ') s from (select doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) p from d, (select distinct w from ish))),
e as (select item_id, w, len(sh) n, unnest(sh) s from ish)
select doc_id, item_id, n::bigint item_shingles, count(*)::bigint shared_shingles, round(count(*)::double / n, 6) containment
from e join dsh using (w, s) group by doc_id, item_id, n having count(*) >= 0.8 * n - 1e-9
"""
