"""Ranked lexical search: an automaton of all query terms is run over the texts; nothing is indexed.

Items (queries) are taken in blocks of a bounded number of items and bytes of terms. A block's terms, each between two guards
(a space on either side), make one Aho-Corasick automaton, which is broadcast. Texts become bytes in which whatever separates terms is a
space, and A-Z are a-z; one run of the automaton over a slice of texts finds every term with its end, so that tf, document frequencies and lengths are
counts of places. The guards make each place one term's: no term ends inside another.

Two passes over the texts, a block at a time: the first sums documents, terms and document frequencies, pre-aggregated in each
task; the second runs again, scores a slice's documents (the terms that were found add their part to the items that hold them) and keeps the best of each item in
the task. What tasks kept is ranked in two steps, by item and salt, then by item. Neither texts nor postings are shuffled.

Score, in integers but for the logarithm: w = floor(1000 ln((2N+2) / (2df+1))), m = 100 - b + (b n N) div L, summed w ((10^9 tf) div (1000 tf + 8 m)).

Defined results: null or blank texts have no terms, are not counted and match nothing; rows that repeat a doc_id or item_id are documents
and items of their own; among equal scores documents without doc_id come last; an empty table gives an empty result. A text longer than a slice stands alone and is
run piece by piece, cut between terms.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_text, releasing, slices, stored

#: Items and bytes of distinct terms of a block: they bound the automaton, the table of its postings and the scores that a slice holds.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20
#: Bytes of text in a slice, and of a piece that the automaton runs over at once.
SLICE, PIECE = 2 << 20, 1 << 19
#: Documents times items whose scores are held at once.
SCORES = 1 << 21
#: Groups that the tasks' best of an item are ranked in first.
SALTS = 64
#: What each byte becomes: a guard, a lower-case letter, or itself.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[str]:
    """Terms as the automaton has them: a character for each UTF-8 byte."""
    return (text or "").encode().translate(BYTES).decode("latin-1").split(" ") if text else []


def guarded(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        a.add_word(f" {t} ", i)
    a.make_automaton()
    return a


def _pieces(data: bytes, size: int):
    """Places of pieces of about so many bytes that begin and end with a guard; neighbours share one."""
    start, last = 0, len(data) - 1
    while start < last:
        end = data.find(b" ", min(start + size, last))
        yield start, end + 1
        start = end


class Counted:
    """What a slice of texts holds: n (terms of each document), and (document, term, tf) of the automaton's terms, sorted."""

    def __init__(self, column, automaton, n_terms: int):
        buf, off = arrow_text(column)
        docs = len(off) - 1
        data = b" ".join([b"", *(buf[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), b""]).translate(BYTES)
        begins = off[:-1] + np.arange(1, docs + 1)
        self.n = np.zeros(docs, np.int64)
        keys, counts = [], []
        for a, b in _pieces(data, PIECE):
            own = np.frombuffer(data, np.uint8, b - a, a) != 32
            first = np.flatnonzero(own[1:] & ~own[:-1]) + 1 + a
            self.n += np.bincount(np.searchsorted(begins, first, "right") - 1, minlength=docs)
            if n_terms and (found := list(automaton.iter(data[a:b].decode("latin-1")))):
                end, term = np.array(found, np.int64).T
                # the last character of a term is before the guard that ends the match
                k, c = np.unique((np.searchsorted(begins, end - 1 + a, "right") - 1) * n_terms + term, return_counts=True)
                keys.append(k)
                counts.append(c)
        keys, counts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts))
        keys, at = np.unique(keys, return_inverse=True)
        self.tf = np.zeros(len(keys), np.int64)
        np.add.at(self.tf, at, counts)
        self.doc, self.term = keys // max(n_terms, 1), keys % max(n_terms, 1)


class Block:
    """Items with the terms they hold: postings (term -> item, times)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = len(items)
        of: dict[str, dict[int, int]] = {}
        for i, (_, terms) in enumerate(items):
            for t in terms:
                own = of.setdefault(t, {})
                own[i] = own.get(i, 0) + 1
        self.terms = list(of)
        self.size = np.array([len(of[t]) for t in self.terms], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.item = np.array([i for t in self.terms for i in of[t]], np.int64)
        self.times = np.array([c for t in self.terms for c in of[t].values()], np.int64)


def blocks(items: DataFrame, item_col: str, text_col: str):
    """Lists of (item_id, terms), a block at a time; the items pass through the driver one block after the other."""
    held, known, size = [], set(), 0
    for r in items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        terms = [t for t in terms_of(r["text"]) if t]
        if not terms:
            continue
        new = sum(map(len, set(terms) - known))
        if held and (len(held) >= BLOCK_ITEMS or size + new > BLOCK_BYTES):
            yield held
            held, known, size, new = [], set(), 0, sum(map(len, set(terms)))
        held.append((r["item"], terms))
        known.update(terms)
        size += new
    if held:
        yield held


def corpus_counts(docs: DataFrame, automaton, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each term of the automaton. docs: text."""

    def of(batches):
        total, words, df = 0, 0, np.zeros(n_terms, np.int64)
        for part in slices(batches, "text", SLICE):
            c = Counted(part.column("text"), automaton.value, n_terms)
            total, words = total + int((c.n > 0).sum()), words + int(c.n.sum())
            df += np.bincount(c.term, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some], pa.int32()), pa.array(np.r_[words, total, df[some]], pa.int64())], names=["term", "n"])

    df, counts = np.zeros(n_terms, np.int64), {-1: 0, -2: 0}
    for r in docs.select("text").mapInArrow(releasing(of), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return counts[-1], counts[-2], df


def _best(item: np.ndarray, doc: np.ndarray, unknown: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item: by score, then by doc_id, unknown ones last."""
    order = np.lexsort((doc, unknown, -score, item))
    own = item[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def best_of_tasks(docs: DataFrame, automaton, block: Block, weights: np.ndarray, total: int, words: int, k: int, b: int) -> DataFrame:
    """item (its place in the block), doc_id, score: the k best of each item in each task. docs: doc_id, text."""
    n_terms, items, size, start, of_item, times = len(block.terms), block.items, block.size, block.start, block.item, block.times
    rows_at_once = max(1, SCORES // items)

    def scored(c: Counted) -> np.ndarray:
        m = 100 - b + (b * c.n * total) // max(words, 1)
        each = weights[c.term] * ((1_000_000_000 * c.tf) // (1000 * c.tf + 8 * m[c.doc]))
        n = size[c.term]
        place = np.repeat(start[c.term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros(len(c.n) * items, np.int64)
        np.add.at(out, np.repeat(c.doc, n) * items + of_item[place], np.repeat(each, n) * times[place])
        return out.reshape(len(c.n), items)

    def of(batches):
        kept = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # item, doc_id, score, without doc_id
        least = np.zeros(items, np.int64)  # of the k best so far; documents below it are out
        for whole in slices(batches, "text", SLICE):
            for part in (whole.slice(at, rows_at_once) for at in range(0, whole.num_rows, rows_at_once)):
                scores = scored(Counted(part.column("text"), automaton.value, n_terms))
                doc, item = np.nonzero((scores > 0) & (scores >= least))
                ids = part.column("doc_id")
                unknown = ids.is_null().to_numpy(zero_copy_only=False)
                new = [item, ids.fill_null(0).to_numpy()[doc], scores[doc, item], unknown[doc]]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                at = _best(kept[0], kept[1], kept[3], kept[2], k)
                kept = [x[at] for x in kept]
                full = np.bincount(kept[0], minlength=items) >= k
                worst = np.searchsorted(kept[0], np.arange(items)) + k - 1
                least = np.where(full, np.r_[kept[2], 0][np.minimum(worst, len(kept[2]))], 0)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(kept[1], pa.int64(), mask=kept[3]), pa.array(kept[2], pa.int64())], names=["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(releasing(of), "item int, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    item_type = dict(items.dtypes)[item_col]
    out = None
    for held in blocks(items, item_col, item_text_col):
        block = Block(held)
        automaton = spark.sparkContext.broadcast(guarded(block.terms))
        total, words, df = corpus_counts(d, automaton, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = best_of_tasks(d, automaton, block, weights, total, words, k, b)
        best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        for keys in (["item", "salt"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"item int, item_id {item_type}")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = stored(found, "ranked") if out is None else out.unionByName(stored(found, "ranked"))
    if out is None:
        return items.select(F.col(item_col).alias("item_id"), F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
with d as materialized (select row_number() over () r, doc_id, {_TERMS} ts from documents),
s as (select count(*) total, sum(len(ts)) words from d where len(ts) > 0),
q as materialized (select i, item_id, term, count(*) times from (select row_number() over () i, item_id, unnest({_TERMS}) term from benchmark) group by all),
tf as materialized (select r, term, count(*) tf from (select r, unnest(ts) term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * total + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, s group by term, total),
m as (select r, doc_id, (25 + (75 * len(ts) * total) // words)::bigint m from d, s where len(ts) > 0),
e as (select i, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join tf using (term) join w using (term) join m using (r) group by i, item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from e where score > 0) where rank <= 10
"""
