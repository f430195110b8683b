"""Substring deduplication over words, by difference-cover anchors.

Words are maximal runs of other than space and the bytes 9 to 13. A window is `window` consecutive words of one document. Every word
that lies in a window whose word sequence also starts anywhere else is removed.

The cover D modulo v meets every pair of positions: for any i and j there is a shift s < v for which (i + s) and
(j + s) are both in D modulo v. Hashing the `window - v + 1` words that start at positions in D is therefore
enough: two equal windows share an anchor at the same shift. Repeated anchors are then extended: the windows
around them, and only those, are hashed whole (128 bits) and grouped.

Stages: text -> anchors dealt by hash -> repeated anchors dealt back by document -> candidate windows dealt by
hash -> repeated windows dealt back -> kept words. What a slice of text repeats itself is sent once with a flag,
so a passage that a third of all documents share costs one record per slice, not one per document.

Defined results: null text has no words; rows that repeat a doc_id, or have none, are documents of their own
(see `common.keyed`); texts shorter than a window lose nothing; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, arrow_text, blob_batch, bucket_column, bucket_of, dealt_text, group_counts, keyed, kind_of, pieces, releasing, Rolling, runs, slices, split_by_repeats, text_bytes, text_of, unpack

#: A perfect difference set: every residue modulo 21 is a difference of two of its members.
COVER, PERIOD = (0, 1, 4, 14, 16), 21
#: Bytes of text that are hashed at once.
SLICE = 6 << 20
ANCHOR = np.dtype([("h", "<u8"), ("k", "<i8"), ("p", "<u4"), ("many", "u1")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("k", "<i8"), ("p", "<u4"), ("many", "u1")])
PLACE = np.dtype([("k", "<i8"), ("p", "<u4")])
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


class Words:
    """Word hashes of a slice of texts, twice over, and which document each word is of."""

    def __init__(self, text, rollers):
        buf, off = arrow_text(text)
        n = len(buf)
        white = ((buf >= 9) & (buf <= 13)) | (buf == 32)
        black = ~white
        begin, end = black.copy(), black.copy()
        begin[1:] &= white[:-1]
        end[:-1] &= white[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        begin[inner] |= black[inner]
        end[inner - 1] |= black[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(starts, off[:-1])
        self.count = np.searchsorted(starts, off[1:]) - self.first
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.at = np.arange(len(starts)) - self.first[self.doc]
        self.rollers = rollers
        self.sums = [r.sums(r.slices(r.sums(r.table[buf]), starts, ends)) for r in rollers]

    def hashes(self, places: np.ndarray, words: int, which: int = 0) -> np.ndarray:
        return self.rollers[which].slices(self.sums[which], places, places + words)


def _rollers(n: int) -> list[Rolling]:
    return [Rolling(seed) for seed in (11, 12)[:n]]


def _split(rec: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Records to exchange (one for each key, flagged where it occurs twice), and those known to repeat here."""
    again, once = split_by_repeats(rec["h"])
    several = rec[again]
    several = several[np.lexsort([several[k] for k in reversed(keys)])]
    at = runs(*(several[k] for k in keys))
    size = np.diff(np.r_[at, len(several)])
    out = several[at]
    out["many"] = size > 1
    return np.concatenate([rec[once], out]), several[np.repeat(size > 1, size)]


def _places(rec: np.ndarray) -> np.ndarray:
    out = np.empty(len(rec), PLACE)
    out["k"], out["p"] = rec["k"], rec["p"]
    return out


def _repeats(rec: np.ndarray, keys: list[str]) -> np.ndarray:
    """Of exchanged records, those of keys that occur twice and were not known to."""
    again, once = split_by_repeats(rec["h"])
    rec = rec[np.concatenate([again, once[rec["many"][once] > 0]])]
    rec = rec[np.lexsort([rec[k] for k in reversed(keys)])]
    at = runs(*(rec[k] for k in keys))
    size = np.diff(np.r_[at, len(rec)])
    twice = (size > 1) | (np.maximum.reduceat(rec["many"], at) > 0) if len(at) else np.empty(0, bool)
    return rec[np.repeat(twice, size) & (rec["many"] == 0)]


def _top_bits(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the upper half of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def remove_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space), a row per input row."""
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    anchor = window - PERIOD + 1
    docs, _ = keyed(docs, id_col, text_col)
    buckets, groups = group_counts(text_bytes(docs))
    docs = docs.withColumn("to", bucket_column(F.col("k"), groups))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def sent_and_known(rec, keys):
        sent, known = _split(rec, keys)
        to = _top_bits(sent["h"], buckets)
        sent["h"] &= np.uint64((1 << 56) - 1)  # the bucket stands for the rest
        yield blob_batch(0, sent, to)
        yield blob_batch(1, _places(known), bucket_of(known["k"], groups), buckets)

    def anchors(batches):
        rollers = _rollers(1)
        for part in slices(batches, "text", SLICE):
            w = Words(part.column("text"), rollers)
            g = np.flatnonzero(cover[w.at % PERIOD] & (w.at + anchor <= w.count[w.doc]) & (w.count[w.doc] >= window))
            rec = np.zeros(len(g), ANCHOR)
            rec["h"] = w.hashes(g, anchor)
            rec["k"] = part.column("k").to_numpy()[w.doc[g]]
            rec["p"] = w.at[g]
            yield from sent_and_known(rec, ["h"])

    def repeated(dtype, keys):
        def of(group: pa.Table) -> pa.Table:
            rec = _repeats(unpack(kind_of(group, 0)["blob"].to_pylist(), dtype), keys)
            return pa.Table.from_batches([blob_batch(1, _places(rec), bucket_of(rec["k"], groups)), *kind_of(group, 1).to_batches()])

        return of

    def located(text: pa.Table, info: pa.Table):
        """(row, place) of what was dealt back to a group of documents, by row."""
        places = unpack(info["blob"].to_pylist(), PLACE)
        k = text["k"].to_numpy()
        order = np.argsort(k)
        row = order[np.searchsorted(k[order], places["k"])] if len(places) else np.empty(0, np.int64)
        order = np.argsort(row, kind="stable")
        return row[order], places["p"].astype(np.int64)[order]

    def windows(key: tuple[pa.Scalar, ...], text: pa.Table, info: pa.Table) -> pa.Table:
        text = text_of(text)
        out = [blob_batch(0, np.empty(0, WINDOW), np.empty(0, np.int64))]
        row, at = located(text, info)
        rollers, base = _rollers(2), 0
        for part in pieces(text, "text", SLICE):
            a, z = np.searchsorted(row, (base, base + part.num_rows))
            if a < z:
                w, r, p = Words(part["text"], rollers), row[a:z] - base, at[a:z]
                edge = np.zeros(len(w.at) + 1, np.int64)
                low, high = w.first[r] + np.maximum(p - PERIOD + 1, 0), w.first[r] + np.minimum(p, w.count[r] - window)
                fits = low <= high
                np.add.at(edge, low[fits], 1)
                np.add.at(edge, high[fits] + 1, -1)
                g = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                rec = np.zeros(len(g), WINDOW)
                rec["h"], rec["g"] = w.hashes(g, window), w.hashes(g, window, 1)
                rec["k"], rec["p"] = part["k"].to_numpy()[w.doc[g]], w.at[g]
                out += sent_and_known(rec, ["h", "g"])
            base += part.num_rows
        return pa.Table.from_batches(out)

    def kept(key: tuple[pa.Scalar, ...], text: pa.Table, info: pa.Table) -> pa.Table:
        text = text_of(text)
        words, removed, texts = [], [], []
        row, at = located(text, info)
        cut = np.searchsorted(row, np.arange(text.num_rows + 1))
        for i, t in enumerate(text["text"].cast(pa.binary()).to_pylist()):
            w = t.split()
            words.append(len(w))
            if cut[i] < cut[i + 1]:
                edge = np.zeros(len(w) + 1, np.int32)
                np.add.at(edge, at[cut[i] : cut[i + 1]], 1)
                np.add.at(edge, at[cut[i] : cut[i + 1]] + window, -1)
                w = list(compress(w, np.cumsum(edge[:-1]) == 0))
            removed.append(words[-1] - len(w))
            texts.append(b" ".join(w).decode())
        columns = [text["doc_id"].combine_chunks(), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

    def back(records: DataFrame, dtype, keys) -> DataFrame:
        """Records meet by hash; what repeats goes to the groups of its documents."""
        return records.groupBy("b").applyInArrow(repeated(dtype, keys), BLOB_SCHEMA).select("to", "blob").groupBy("to")

    found = docs.select("k", "text").mapInArrow(releasing(anchors), BLOB_SCHEMA)
    texts = dealt_text(docs).groupBy("to")
    found = texts.cogroup(back(found, ANCHOR, ["h"])).applyInArrow(windows, BLOB_SCHEMA)
    return texts.cogroup(back(found, WINDOW, ["h", "g"])).applyInArrow(kept, RESULT)


def digests(result: DataFrame) -> DataFrame:
    """The result with its text as a digest."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
