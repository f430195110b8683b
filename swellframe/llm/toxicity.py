"""Toxicity scores from class-conditional Kneser-Ney models of words and word pairs.

Each class c (toxic, ordinary) has an interpolated bigram model over the expressions, the pairs of neighbouring words that either class has more
than once: p_c(w | v) = max(n_c(v, w) - 1, 0) / n_c(v) + l_c(v) p_c(w), with l_c(v) what the discounts leave. Pairs seen once carry no mass of
their own, so a pair that is no expression backs off to its word in both classes. Words: p_c(w) = max(n_c(w) - D, 0) / n_c + l_c p(w), where
both classes share the Kneser-Ney lower order p(w): the number of different left neighbours that w has in the labelled documents, discounted
in turn towards its frequency in all documents. A rare expression that one class has not seen is thus judged by the same counts in either class.

* Counting: a slice of text sends a record per distinct word with its counts, dealt by word; counts cover the whole corpus, and a very common word
  is one record of each slice.
* Pairs: a slice of labelled text sends each distinct pair once, with its counts by class, to the bucket of its right word, where neighbours are counted
  exactly. Words with over one in HOT_PART of all occurrences (at most HOT_PART of them) are dealt by both words of the pair instead.
* Model: a written table of log ratios of every labelled word (with what it adds as a left neighbour) and of every expression (what it adds
  to its words). Words that no label has seen share one ratio. Up to MODEL_ENTRIES entries are sent to tasks; beyond, the most frequent words of the
  corpus and expressions are sent, and what else a document has is joined to the table. Both give the same scores at every size.
* Score: a logistic function of the length-normalised log-likelihood difference of the two models, its sum over n and over sqrt(n), and of the part
  of it that strong words and strong expressions give (their ratio beyond STRONG), which the noise of long texts does not drown. It is fitted on
  the labelled rows that the counts leave out (one in CALIBRATE_ONE_IN), at most CALIBRATION_ROWS of them; no weight may be negative.

Words are runs of letters in lower case; they and pairs go by 64-bit hashes, of which two in 10^9 words are equal with a chance of 3 %.
Labels of held-out rows are never read: crc32(doc_id as text) mod `folds` = `held_out`.

Defined results: null and empty texts are scored by the intercept; labels that repeat a doc_id count as toxic if any says so;
without labels of both classes every score is the share of toxic labels (0 if none); an empty table gives an empty
result; other columns (also lang and source) are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, group_counts, mix, releasing, runs, slices, stored, text_bytes, text_key, unpack, without_rows

#: Entries of the model that are sent to tasks (12 bytes each); further ones are joined.
MODEL_ENTRIES = 4_000_000
#: Labels (doc_id, toxic) up to which they are broadcast to the documents, else joined by shuffle.
BROADCAST_LABELS = 2_000_000
CALIBRATE_ONE_IN, CALIBRATION_ROWS = 5, 20_000
STRONG = 2.0
FEATURES = ("x1", "x2", "x3", "x4", "x5", "x6")
#: Sums of a document: over words and over expressions, of ratios and of what exceeds STRONG.
SUMS = ("a", "s", "ap", "sp")
#: Bytes of text whose words are counted together, and that are scored together.
SLICE, SCORED = 2 << 20, 1 << 20
HOT_PART = 4096
#: Discount of the shared lower order.
SHARED_DISCOUNT = 0.5
WORD = re.compile(r"[^\W\d_]+")
COUNT = np.dtype([("w", "<u8"), ("toxic", "<u4"), ("ordinary", "<u4"), ("total", "<u4")])
PAIR = np.dtype([("w", "<u8"), ("v", "<u8"), ("toxic", "<u4"), ("ordinary", "<u4")])


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words of texts, the number of each word in its order, and how many words a text has."""
    number: dict[str, int] = {}
    ids, size = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = words(text)
        size[i] = len(w)
        ids.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w)))
    digest = xxhash.xxh3_64_intdigest
    keys = np.fromiter((digest(x.encode()) for x in number), np.uint64, len(number))
    return keys, np.concatenate(ids) if ids else np.empty(0, np.int32), size


def bucket_of_key(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left << np.uint64(17) | left >> np.uint64(47)) ^ right)


def word_counts(docs: DataFrame) -> DataFrame:
    """key, toxic, ordinary (counts in labelled documents), total (in all). docs: text, label (1, 0 or null).

    A slice sends a record per distinct word, packed by bucket: far fewer and smaller rows than words.
    """
    buckets, _ = group_counts(text_bytes(docs))
    names = ("toxic", "ordinary", "total")

    def counted(batches):
        for part in slices(batches, "text", SLICE):
            keys, own, size = numbered(part.column("text").to_pylist())
            of = np.repeat(part.column("label").fill_null(2).to_numpy(zero_copy_only=False), size)
            rec = np.empty(len(keys), COUNT)
            rec["w"] = keys
            for name, at in zip(names, (of == 1, of == 0, slice(None)), strict=True):
                rec[name] = np.bincount(own[at], minlength=len(keys))
            ids, blobs = dealt(rec, bucket_of_key(keys, buckets))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["b", "blob"])

    def summed(group: pa.Table) -> pa.Table:
        rec = unpack(group["blob"].to_pylist(), COUNT)
        rec = rec[np.argsort(rec["w"])]
        at = runs(rec["w"])
        return pa.table([pa.array(rec["w"][at].view(np.int64)), *(pa.array(np.add.reduceat(rec[c].astype(np.int64), at)) for c in names)], names=["key", *names])

    sent = docs.select("text", F.col("label").cast("int").alias("label")).mapInArrow(releasing(counted), "b int, blob binary")
    return sent.groupBy("b").applyInArrow(summed, "key bigint, toxic bigint, ordinary bigint, total bigint")


def pair_counts(labelled: DataFrame, hot: np.ndarray) -> DataFrame:
    """Of labelled documents (text, label): w and neighbours, how many different words stand left of it (in parts, for hot words), and, with v
    not null, the pairs (v, w) that either class has more than once, with their key and counts by class."""
    buckets, _ = group_counts(text_bytes(labelled))
    hot = np.sort(hot)

    def met(batches):
        for part in slices(batches, "text", SLICE):
            keys, own, size = numbered(part.column("text").to_pylist())
            if not len(own):
                continue
            first = np.cumsum(size)[size > 0] - size[size > 0]
            left = np.r_[0, own[:-1]].astype(np.int64) + 1
            left[first] = 0  # the start of a text is a neighbour too
            code, back = np.unique(left * len(keys) + own, return_inverse=True)
            toxic = np.repeat(part.column("label").to_numpy(zero_copy_only=False) == 1, size)
            rec = np.empty(len(code), PAIR)
            rec["w"], rec["v"] = keys[code % len(keys)], np.r_[np.uint64(0), keys][code // len(keys)]
            rec["toxic"] = np.bincount(back, toxic, len(code))
            rec["ordinary"] = np.bincount(back, ~toxic, len(code))
            many = hot[np.minimum(np.searchsorted(hot, rec["w"]), len(hot) - 1)] == rec["w"] if len(hot) else np.zeros(len(rec), bool)
            ids, blobs = dealt(rec, bucket_of_key(np.where(many, pair_keys(rec["v"], rec["w"]), rec["w"]), buckets))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["b", "blob"])

    def summed(group: pa.Table) -> pa.Table:
        rec = unpack(group["blob"].to_pylist(), PAIR)
        rec = rec[np.lexsort((rec["v"], rec["w"]))]
        at = runs(rec["w"], rec["v"])
        toxic, ordinary = (np.add.reduceat(rec[c].astype(np.int64), at) for c in ("toxic", "ordinary"))
        w, v = rec["w"][at], rec["v"][at]
        of_w = runs(w)
        own = ((toxic > 1) | (ordinary > 1)) & (v != 0)
        none = np.zeros(len(of_w), np.int64)
        signed = lambda a, b: pa.array(np.concatenate([a, b]).view(np.int64))
        columns = [signed(w[of_w], w[own]), pa.array(np.r_[none, v[own].view(np.int64)], mask=np.r_[none == 0, np.zeros(own.sum(), bool)]), signed(none.view(np.uint64), pair_keys(v[own], w[own]))]
        columns += [pa.array(np.r_[none, toxic[own]]), pa.array(np.r_[none, ordinary[own]]), pa.array(np.r_[np.diff(np.r_[of_w, len(w)]), np.zeros(own.sum(), np.int64)])]
        return pa.table(columns, names=["w", "v", "key", "toxic", "ordinary", "neighbours"])

    sent = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(releasing(met), "b int, blob binary")
    return stored(sent.groupBy("b").applyInArrow(summed, "w bigint, v bigint, key bigint, toxic bigint, ordinary bigint, neighbours bigint"), "pairs")


def model(counts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, float] | None:
    """The table of ratios (key, value, total; pair: whether it is an expression), and the ratio of words without a label."""
    known = counts.where("toxic + ordinary > 0")
    discounted = lambda c: (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"), F.count_if(F.col(c) == 1).alias(f"once_{c}"), F.count_if(F.col(c) == 2).alias(f"twice_{c}"))
    t = known.agg(F.count("*").alias("kinds"), F.sum("total").alias("total"), *discounted("toxic"), *discounted("ordinary")).first()
    if not t["n_toxic"] or not t["n_ordinary"]:
        return None
    seen = pairs.where("v is null").groupBy(F.col("w").alias("key")).agg(F.sum("neighbours").alias("neighbours"))
    all_seen = pairs.agg(F.sum("neighbours").alias("n")).first()["n"]
    shared = (F.greatest(F.col("neighbours") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * t["kinds"] * F.col("total") / t["total"]) / all_seen

    expressions = pairs.where("v is not null").select("v", "w", "key", "toxic", "ordinary")
    mass = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    taken = expressions.groupBy(F.col("v").alias("key")).agg(F.sum(mass("toxic")).alias("of_toxic"), F.sum(mass("ordinary")).alias("of_ordinary"))
    w = known.join(seen, "key", "left").join(taken, "key", "left").na.fill(0, ["neighbours", "of_toxic", "of_ordinary"])
    unseen = {}
    for c in ("toxic", "ordinary"):
        once, twice = t[f"once_{c}"], t[f"twice_{c}"]
        d = min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.5
        unseen[c] = d * t[f"kinds_{c}"] / t[f"n_{c}"]
        w = w.withColumn(f"p_{c}", F.greatest(F.col(c) - d, F.lit(0.0)) / t[f"n_{c}"] + unseen[c] * shared)
        w = w.withColumn(f"left_{c}", F.when(F.col(c) > 0, 1.0 - F.col(f"of_{c}") / F.col(c)).otherwise(1.0))
    own, after = F.log(F.col("p_toxic") / F.col("p_ordinary")), F.log(F.col("left_toxic") / F.col("left_ordinary"))
    w = stored(w.select("key", "total", "toxic", "ordinary", "p_toxic", "p_ordinary", "left_toxic", "left_ordinary", own.alias("own"), after.alias("after")), "words")

    right = w.select(F.col("key").alias("w"), "p_toxic", "p_ordinary", "own")
    before = w.select(F.col("key").alias("v"), F.col("toxic").alias("n_toxic"), F.col("ordinary").alias("n_ordinary"), "left_toxic", "left_ordinary", "after")
    e = expressions.join(right, "w").join(before, "v")
    p = {c: F.when(F.col(f"n_{c}") > 0, mass(c) / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"left_{c}") * F.col(f"p_{c}") for c in ("toxic", "ordinary")}
    e = e.select("key", (F.log(p["toxic"] / p["ordinary"]) - F.col("own") - F.col("after")).alias("value"), (F.col("toxic") + F.col("ordinary")).alias("total"), F.lit(True).alias("pair"))
    table = w.select("key", (F.col("own") + F.col("after")).alias("value"), "total", F.lit(False).alias("pair")).unionByName(e)
    return stored(table, "ratios"), math.log(unseen["toxic"] / unseen["ordinary"])


def _sorted(rows: DataFrame, is_pair: bool) -> tuple[np.ndarray, np.ndarray]:
    t = rows.where(F.col("pair") == is_pair).select("key", F.col("value").cast("float").alias("value")).toArrow()
    key, value = t["key"].to_numpy().view(np.uint64), t["value"].to_numpy()
    order = np.argsort(key)
    return key[order], value[order]


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key; NaN for those that are not there."""
    if not len(keys):
        return np.full(len(asked), np.nan, np.float32)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.float32(np.nan))


def features(docs: DataFrame, counts: DataFrame, table: DataFrame, other: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and carried columns, with the sums of log ratios, and of what exceeds STRONG, over n and over sqrt(n)."""
    table = table.withColumn("value", F.col("value").cast("float"))
    joined = table.limit(MODEL_ENTRIES + 1).count() > MODEL_ENTRIES
    sent = table
    if joined:  # the most frequent of all words, labelled or not, and expressions
        rest = counts.where("toxic + ordinary = 0").select("key", F.lit(other).cast("float").alias("value"), "total", F.lit(False).alias("pair"))
        sent = table.unionByName(rest).orderBy(F.col("total").desc(), "key").limit(MODEL_ENTRIES)
        sent = stored(sent, "sent")
    shared = docs.sparkSession.sparkContext.broadcast((_sorted(sent, False), _sorted(sent, True)))

    def summed(batches):
        of_words, of_pairs = shared.value
        for part in slices(batches, "text", SCORED):
            keys, own, n = numbered(part.column("text").to_pylist())
            doc = np.repeat(np.arange(len(n)), n)
            inner = np.flatnonzero(doc[1:] == doc[:-1])
            asked = pair_keys(keys[own[inner]], keys[own[inner + 1]])
            values, of = [looked_up(*of_words, keys)[own].astype(float), looked_up(*of_pairs, asked).astype(float)], [doc, doc[inner]]
            columns = [*(part.column(c) for c in ("doc_id", *carried, "row")), pa.array(n)]
            for x, d, without in zip(values, of, (0.0 if joined else other, 0.0), strict=True):
                x = np.where(np.isnan(x), without, x)
                columns += [pa.array(np.bincount(d, y, len(n)).astype(float)) for y in (x, np.maximum(x - STRONG, 0))]
            if joined:
                unknown, of = np.isnan(np.concatenate(values)), np.concatenate(of)
                key = np.r_[keys[own], asked][unknown]
                rec, times = np.unique(np.stack([of[unknown], key.view(np.int64), np.flatnonzero(unknown) >= len(own)], axis=1), axis=0, return_counts=True)
                cut = np.r_[0, np.cumsum(np.bincount(rec[:, 0], minlength=len(n)))].astype(np.int32)
                asks = pa.StructArray.from_arrays([pa.array(rec[:, 1].copy()), pa.array(rec[:, 2] == 1), pa.array(times.astype(np.int64))], names=["key", "pair", "times"])
                columns.append(pa.ListArray.from_arrays(pa.array(cut), asks))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *carried, "row", "n", *SUMS, *(["unknown"] if joined else [])])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id bigint", *(f"{c} {kinds[c]}" for c in carried), "row bigint, n bigint", *(f"{c} double" for c in SUMS)]) + (", unknown array<struct<key bigint, pair boolean, times bigint>>" if joined else "")
    out = docs.select("doc_id", *carried, F.monotonically_increasing_id().alias("row"), "text").mapInArrow(releasing(summed), schema)
    if joined:
        out = stored(out, "sums")
        asked = out.select("row", F.inline("unknown"))
        # words that the table does not have keep the ratio of words without a label; pairs that it does not have add nothing
        base = asked.where("not pair").groupBy("row").agg(F.sum("times").alias("others"))
        found = asked.join(table.select("key", "pair", "value"), ["key", "pair"])
        less = F.when(F.col("pair"), 0.0).otherwise(F.lit(other))
        strong = lambda x: F.greatest(x - STRONG, F.lit(0.0))
        found = found.groupBy("row").agg(*(F.sum(F.when(is_pair, F.col("times") * x).otherwise(0.0)).alias(f"{c}1") for c, is_pair, x in zip(SUMS, (~F.col("pair"), ~F.col("pair"), F.col("pair"), F.col("pair")), (F.col("value") - less, strong(F.col("value")) - strong(less)) * 2, strict=True)))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        out = out.drop("unknown").join(base, "row", "left").join(found, "row", "left")
        out = out.withColumns({c: F.col(c) + zero(f"{c}1") + zero("others") * x for c, x in zip(SUMS, (other, max(other - STRONG, 0.0), 0.0, 0.0), strict=True)})
    length = F.greatest(F.col("n"), F.lit(1)).cast("double")
    both = F.col("a") + F.col("ap")
    sums = (both / length, both / F.sqrt(length), F.col("s") / length, F.col("s") / F.sqrt(length), F.col("sp") / length, F.col("sp") / F.sqrt(length))
    out = stored(out.select("doc_id", *carried, *(c.alias(f) for c, f in zip(sums, FEATURES, strict=True))), "features")
    shared.destroy()
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights (intercept first) of a ridge logistic regression, by Newton's method.

    Columns whose weights would be negative are left out, one after the other.
    """
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), (x - mean)[:, used] / dev[used]])
        w = np.zeros(z.shape[1])
        ridge = np.diag([0.0, *[1.0] * len(used)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        if not used or w[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(i + 1 for i in used)]] = w
            return mean, dev, out
        del used[int(np.argmin(w[1:]))]


def scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, held_out, score, predicted, a row per input row."""
    known = labels.select(F.col("doc_id").alias("of"), F.col(label_col).cast("int").alias("y")).where("of is not null and y is not null")
    known = stored(known.where(F.pmod(fold_of(F.col("of")), F.lit(folds)) != held_out).groupBy("of").agg(F.max("y").alias("y")), "labels")
    n = known.count()
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *carried, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near = F.broadcast(known) if n <= BROADCAST_LABELS else known
    fold = fold_of(F.col("doc_id"))
    fit = F.pmod(F.floor(fold / folds), F.lit(CALIBRATE_ONE_IN)) == 0
    labelled = d.join(near, F.col("doc_id") == F.col("of"), "left").select("text", F.when(~fit, F.col("y")).alias("label"))
    counts = stored(word_counts(labelled), "counts")
    all_words = counts.agg(F.sum("total").alias("n")).first()["n"] or 0
    hot = counts.where(F.col("total") > all_words / HOT_PART).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    made = model(counts, pair_counts(labelled.where("label is not null"), hot))
    score = None
    if made:
        out = features(d, counts, *made, carried)
        sample = out.join(near, F.col("doc_id") == F.col("of")).where(fit)
        sample = sample.select("doc_id", *FEATURES, "y").orderBy(F.crc32(F.concat_ws("-", F.lit("fit"), "doc_id").cast("binary")), "doc_id").limit(CALIBRATION_ROWS).collect()
        x = np.array([[r[c] for c in FEATURES] for r in sample]).reshape(-1, len(FEATURES))
        y = np.array([r["y"] for r in sample], float)
        if 0 < y.sum() < len(y):
            mean, dev, w = logistic(x, y)
            line = F.lit(float(w[0]))
            for i, c in enumerate(FEATURES):
                line = line + (F.col(c) - float(mean[i])) / float(dev[i]) * float(w[i + 1])
            score = 1.0 / (1.0 + F.exp(-line))
    else:
        out = d
    if score is None:
        score = F.lit(float(known.agg(F.avg("y").alias("p")).first()["p"] or 0.0))
    fold = F.pmod(fold_of(F.col("doc_id")), F.lit(folds)) == held_out
    return out.select("doc_id", *carried, F.coalesce(fold, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with. Rows go one by one: those that share a doc_id, or have
    none, are told apart by their texts."""
    bad = scores(docs.select("doc_id", "text", text_key().alias("of_text")), labels, threshold=threshold, carried=("of_text",)).where("predicted = 1")
    return without_rows(docs, stored(bad.select("doc_id", "of_text"), "toxic"))
