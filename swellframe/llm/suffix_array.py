"""Removal of long repeated byte strings, by run-length suffix indexes of the places that can match.

Every byte that lies in a `window`-byte string (UTF-8) that also starts in a document with a smaller id is
removed; matches never cross documents.

1. Minimisers deal the work: of the k-mers of a window the one with the smallest hash is its anchor, so equal
   windows have equal anchors. Neighbouring windows with one anchor form a segment. Segments are dealt by anchor.
2. Where the segments of an anchor are equal, the first document keeps its segment and the others lose theirs.
   Only anchors with differing segments need the text: these segments are fetched and dealt to a shard each.
3. A shard builds a suffix array of its segments in document order, the run-length Burrows-Wheeler transform with
   the samples at run ends, and streams matching statistics (as far as the window is long): the sample at a run's
   start has the smallest document of the run, and a suffix matches an earlier document if that of another run, or
   place, of the same context is smaller than its own.
   An anchor with very many differing segments (a phrase in a large share of all documents) would make one shard grow
   with the corpus. Its windows are hashed one by one instead (128 bits) and dealt by that hash, the smallest document of a
   group of texts standing for the others of the group.
4. Marks go back to the documents, and the bytes that are left are put together.

A slice of text sends one record for each of its distinct segments, so that a passage of a third of all documents does not gather at one
place. A segment that a document has many times is sent once; its other places copy the marks.

Defined results: null text is empty; rows that share a doc_id are documents of their own that have nothing of each other removed, since neither has
the smaller doc_id; so are rows without a doc_id, which come after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, arrow_text, blob_batch, bucket_column, bucket_of, dealt_text, group_counts, keyed, kind_of, mix, pieces, releasing, Rolling, runs, split_by_repeats, text_bytes, text_of, unpack

#: Bytes of text that are hashed at once, and whose segments are compared before they are sent.
SLICE, COMPARED = 1 << 18, 2 << 20
#: Bytes of text that a task deals out at once.
DEALT = 4 << 20
#: A longer text is worked on in parts that overlap.
LONGEST = 64 << 20
#: Bits of a position in the packed (hash, position) keys of the sliding minimum.
PLACE_BITS = np.uint64(28)
#: open: 0 a settled mark, 1 a segment for the index, 2 one of an anchor with very many segments, 3 a segment that the document has
#: already at place b. h tells anchors of a bucket apart.
MARK = np.dtype([("k", "<i8"), ("s", "<u4"), ("l", "<u2"), ("open", "u1"), ("b", "<u4"), ("h", "<u4")])
#: An anchor with more differing segments than this is dealt by its windows; bytes that one index holds, unless an anchor has more.
MANY_SEGMENTS, INDEX_BYTES = 4096, 1 << 18
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "


def records(repeats: bool, longest: int) -> tuple[np.dtype, np.dtype, np.dtype, str]:
    """Types of segments, of segments with their text and of windows, and the field that orders documents: k, or where rows share a doc_id the
    first k of that, so that they have nothing of each other removed."""
    first = [("o", "<i8")] if repeats else []
    segment = np.dtype([("h", "<u8"), ("g", "<u8"), ("k", "<i8"), *first, ("s", "<u4"), ("l", "<u2")])
    piece = np.dtype([("k", "<i8"), *first, ("s", "<u4"), ("l", "<u2"), ("h", "<u4"), ("text", "u1", (longest,))])
    window = np.dtype([("h", "<u8"), ("g", "<u8"), ("k", "<i8"), *first, ("s", "<u4")])
    return segment, piece, window, "o" if repeats else "k"


def anchor_length(window: int) -> int:
    return max(4, window // 3)


def segments(buf: np.ndarray, off: np.ndarray, window: int, roller: Rolling):
    """(document, start, length, anchor hash, segment hash) of all segments of a slice of texts."""
    k, n = anchor_length(window), len(buf)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if n < window:
        return none
    sums = roller.sums(roller.table[buf])
    h = mixed(sums, k, roller)
    width = window - k + 1
    low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)[: len(anchor)]
    whole = np.flatnonzero(np.arange(len(anchor)) + window <= off[doc + 1])
    if not len(whole):
        return none
    first = runs(anchor[whole], doc[whole])
    start, last = whole[first], whole[np.r_[first[1:] - 1, len(whole) - 1]]
    end = last + window
    # the smallest hashes of windows are all small: mixed again, they deal anchors evenly
    return doc[start], start, end - start, mix(h[anchor[start]]), roller.slices(sums, start, end)


def mixed(sums: np.ndarray, k: int, roller: Rolling) -> np.ndarray:
    at = np.arange(len(sums) - k)
    return roller.slices(sums, at, at + k)


def _marks(k, s, l, is_open=0, bucket=0, h=0) -> np.ndarray:
    out = np.empty(len(k), MARK)
    out["k"], out["s"], out["l"], out["open"], out["b"], out["h"] = k, s, l, is_open, bucket, h
    return out


def _smallest_of_equal(rec: np.ndarray, order: str) -> tuple[np.ndarray, np.ndarray]:
    """Records of the smallest document of each (h, g), and the others."""
    again, once = split_by_repeats(rec["h"])
    several = rec[again]
    several = several[np.lexsort((several["s"], several["k"], several["g"], several["h"]))]
    at = runs(several["h"], several["g"])
    least = np.repeat(several[order][at], np.diff(np.r_[at, len(several)]))
    return np.concatenate([rec[once], several[several[order] == least]]), several[several[order] > least]


def _once_per_document(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first record of each (h, g, k), the others, and where the first of each of them is."""
    again, once = split_by_repeats(rec["h"])
    several = rec[again]
    several = several[np.lexsort((several["s"], several["k"], several["g"], several["h"]))]
    at = runs(several["h"], several["g"], several["k"])
    first = np.repeat(several["s"][at], np.diff(np.r_[at, len(several)]))
    other = several["s"] != first
    return np.concatenate([rec[once], several[at]]), several[other], first[other]


class RunLengthIndex:
    """Suffix array to a depth, run-length transform and run-end samples of texts laid end to end.

    whole: which places have `depth` bytes of their own text; others are left out. Suffixes with equal contexts of
    `depth` bytes are in the order of their places.
    """

    def __init__(self, text: np.ndarray, depth: int, whole: np.ndarray):
        n = len(text)
        padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
        rank = np.zeros(n + depth, np.uint64)
        for i in range(min(8, depth)):
            rank = (rank << np.uint64(8)) | padded[i : i + n + depth]
        rank, reach = self._dense(rank), min(8, depth)
        while reach < depth:
            step = min(reach, depth - reach)
            ahead = np.concatenate([rank[step:], np.zeros(step, np.uint64)])
            rank, reach = self._dense((rank << np.uint64(32)) | ahead), reach + step
        rank = rank[:n]
        places = np.flatnonzero(whole)
        self.order = places[np.argsort(rank[places] << np.uint64(32) | places.astype(np.uint64))]
        context = rank[self.order]
        before = padded[self.order - 1]
        self.starts = runs(context, before)  # a run ends with its context too
        self.ends = np.r_[self.starts[1:], [len(self.order)] * (len(self.order) > 0)].astype(np.int64) - 1
        self.heads = before[self.starts]
        self.samples = self.order[self.starts], self.order[self.ends]
        self.contexts = runs(context[self.starts])

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        out = np.empty(len(keys), np.uint64)
        s = keys[order]
        out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]).astype(np.uint64)
        return out

    def smallest_owner(self, owner: np.ndarray) -> np.ndarray:
        """For each place of the index, the smallest owner of a place with the same context. owner is ascending."""
        if not len(self.starts):
            return owner
        of_run = owner[self.samples[0]]  # in a run places ascend, and so do owners
        least = np.minimum.reduceat(of_run, self.contexts)
        per_run = np.repeat(least, np.diff(np.r_[self.contexts, len(self.starts)]))
        out = owner.copy()
        out[self.order] = np.repeat(per_run, self.ends - self.starts + 1)
        return out


def remove_repeated_strings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left), a row per input row; then the carried columns.

    as_text: kept is a string; a character of which only some bytes would be removed goes wholly.
    """
    longest = 2 * window - anchor_length(window)
    types = dict(docs.dtypes)
    more = [f"x{i}" for i in range(len(carried))]
    schema = RESULT + ", ".join([f"kept {'string' if as_text else 'binary'}", *(f"{x} {types[c]}" for x, c in zip(more, carried, strict=True))])
    docs, repeats = keyed(docs, id_col, text_col, carried)
    segment, piece, window_type, order = records(repeats, longest)
    buckets, groups = group_counts(text_bytes(docs))
    docs = docs.withColumn("to", bucket_column(F.col("k"), groups))

    def parts(table):
        """(keys, orders, bases, bytes, offsets) of slices; a very long text comes in overlapping parts."""
        for part in pieces(table, "text", SLICE):
            buf, off = arrow_text(part.column("text"))
            k, o = part.column("k").to_numpy(), part.column("first").to_numpy()
            if len(buf) <= LONGEST:
                yield k, o, 0, buf, off
            else:
                for base in range(0, len(buf) - window + 1, LONGEST):
                    own = buf[base : base + LONGEST + window - 1]
                    yield k, o, base, own, np.array([0, len(own)])

    def anchors(batches):
        roller, held, size = Rolling(21), [], 0

        def sent():
            rec, again, at = _once_per_document(np.concatenate(held))
            rec, later = _smallest_of_equal(rec, order)
            to = ((rec["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rec["h"] &= np.uint64(0xFFFFFFFF)  # the bucket stands for the rest
            yield blob_batch(0, rec, to)
            settled = np.concatenate([_marks(later["k"], later["s"], later["l"]), _marks(again["k"], again["s"], again["l"], 3, at)])
            yield blob_batch(1, settled, bucket_of(settled["k"], groups), buckets)

        for batch in batches:
            for k, o, base, buf, off in parts(batch):
                doc, start, length, h, g = segments(buf, off, window, roller)
                rec = np.empty(len(doc), segment)
                rec["h"], rec["g"], rec["k"], rec["s"], rec["l"] = h, g, k[doc], start - off[doc] + base, length
                rec[order] = o[doc] if repeats else rec["k"]
                held.append(rec)
                size += len(buf)
                if size >= COMPARED:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()

    def decided(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Marks of later copies of equal segments; `open` marks of segments whose anchor has others too."""
        rec = unpack(kind_of(group, 0)["blob"].to_pylist(), segment)
        rec = rec[split_by_repeats(rec["h"])[0]]
        rec = rec[np.lexsort((rec["k"], rec["g"], rec["h"]))]
        at, of_h = runs(rec["h"], rec["g"]), runs(rec["h"])
        least = np.repeat(rec[order][at], np.diff(np.r_[at, len(rec)]))
        spread = np.diff(np.r_[of_h, len(rec)])
        several = np.repeat(np.diff(np.r_[np.searchsorted(at, of_h), len(at)]) > 1, spread)
        if len(of_h):
            several &= np.repeat(np.minimum.reduceat(rec[order], of_h) < np.maximum.reduceat(rec[order], of_h), spread)
        later = rec[rec[order] > least]
        first = rec[several & (rec[order] == least)]
        of = runs(first["h"])
        size = np.diff(np.r_[of, len(first)])
        kind = np.repeat(np.where(size > MANY_SEGMENTS, 2, 1), size)
        out = np.concatenate([_marks(later["k"], later["s"], later["l"]), _marks(first["k"], first["s"], first["l"], kind, key[0].as_py(), first["h"])])
        return pa.Table.from_batches([blob_batch(1, out, bucket_of(out["k"], groups)), *kind_of(group, 1).to_batches()])

    def located(text: pa.Table, blobs: list):
        marks = unpack(blobs, MARK)
        k = text["k"].to_numpy()
        order = np.argsort(k)
        row = order[np.searchsorted(k[order], marks["k"])] if len(marks) else np.empty(0, np.int64)
        order = np.argsort(row, kind="stable")
        return row[order], marks[order]

    def fetched(key: tuple[pa.Scalar, ...], text: pa.Table, info: pa.Table) -> pa.Table:
        """The bytes of open segments go to their shards; settled marks go on."""
        text = text_of(text)
        row, marks = located(text, info["blob"].to_pylist())
        settled = marks[(marks["open"] == 0) | (marks["open"] == 3)]
        before = text["first"].to_numpy() if text.num_rows else np.empty(0, np.int64)
        buf, off = arrow_text(text["text"])
        own, m = row[marks["open"] == 1], marks[marks["open"] == 1]
        rec = np.zeros(len(m), piece)
        for c in ("k", "s", "l", "h"):
            rec[c] = m[c]
        rec[order] = before[own] if repeats else rec["k"]
        for i in range(0, len(m), 1 << 12):
            some = slice(i, i + (1 << 12))
            at = (off[own[some]] + m["s"][some])[:, None] + np.arange(longest)
            rec["text"][some] = np.where(np.arange(longest) < m["l"][some][:, None], buf[np.minimum(at, len(buf) - 1)], 0)
        out = [blob_batch(0, rec, m["b"].astype(np.int64)), blob_batch(1, settled, bucket_of(settled["k"], groups), buckets)]
        own, m = row[marks["open"] == 2], marks[marks["open"] == 2]
        if len(m):
            rollers = [Rolling(31), Rolling(32)]
            each = m["l"].astype(np.int64) - window + 1
            of = np.repeat(np.arange(len(m)), each)
            step = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            rec = np.empty(len(of), window_type)
            rec["k"], rec["s"] = m["k"][of], m["s"][of] + step
            rec[order] = before[own[of]] if repeats else rec["k"]
            doc = own[of]
            for r in np.unique(doc):
                mine = doc == r
                start = rec["s"][mine].astype(np.int64)
                for name, roller in zip(("h", "g"), rollers, strict=True):
                    rec[name][mine] = roller.slices(roller.sums(roller.table[buf[off[r] : off[r + 1]]]), start, start + window)
            rec, later = _smallest_of_equal(rec, order)
            to = ((rec["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            out.append(blob_batch(2, rec, to))
            later = _marks(later["k"], later["s"], window)
            out.append(blob_batch(1, later, bucket_of(later["k"], groups), buckets))
        return pa.Table.from_batches(out)

    def matched(rec: np.ndarray) -> np.ndarray:
        """Marks of what an index of these segments finds."""
        rec = rec[np.lexsort((rec["s"], rec["k"]))]  # k is in the order of `order`
        size = rec["l"].astype(np.int64)
        text = rec["text"][np.arange(longest) < size[:, None]]
        of = np.repeat(np.arange(len(rec)), size)
        start = np.cumsum(size) - size
        at = np.arange(len(text)) - start[of]
        owner = rec[order][of]
        least = RunLengthIndex(text, window, at + window <= size[of]).smallest_owner(owner)
        hit = np.flatnonzero(least < owner)
        first = runs(of[hit], hit - np.arange(len(hit)))
        last = hit[np.r_[first[1:] - 1, len(hit) - 1]] if len(hit) else hit
        first = hit[first]
        return _marks(rec["k"][of[first]], rec["s"][of[first]] + at[first], last - first + window)

    def indexed(group: pa.Table) -> pa.Table:
        out = [_marks(*np.empty((3, 0), np.int64))]
        rec = unpack(kind_of(group, 0)["blob"].to_pylist(), piece)
        rec = rec[np.argsort(rec["h"], kind="stable")]
        size = np.cumsum(rec["l"], dtype=np.int64)
        anchors_at = np.r_[runs(rec["h"]), len(rec)]
        i = 0
        while i < len(anchors_at) - 1:  # whole anchors, as many as one index should hold
            a = anchors_at[i]
            done = size[a - 1] if a else 0
            j = max(i + 1, int(np.searchsorted(size[anchors_at[1:] - 1], done + INDEX_BYTES, "right")))
            out.append(matched(rec[a : anchors_at[j]]))
            i = j
        _, later = _smallest_of_equal(unpack(kind_of(group, 2)["blob"].to_pylist(), window_type), order)
        out.append(_marks(later["k"], later["s"], window))
        marks = np.concatenate(out)
        return pa.Table.from_batches([blob_batch(1, marks, bucket_of(marks["k"], groups)), *kind_of(group, 1).to_batches()])

    def with_copies(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the marks of a document. What is marked within a segment is marked within its other places in the document too:
        marks begin where windows do, and a window belongs to one segment."""
        again = m[m["open"] == 3]
        m = m[m["open"] == 0]
        start, length = m["s"].astype(np.int64), m["l"].astype(np.int64)
        if not len(again) or not len(m):
            return start, length
        by = np.argsort(start, kind="stable")
        start, length = start[by], length[by]
        at = again["b"].astype(np.int64)
        low = np.searchsorted(start, at)
        n = np.maximum(np.searchsorted(start, at + again["l"].astype(np.int64) - window, "right") - low, 0)
        of = np.repeat(np.arange(len(again)), n)
        own = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return np.r_[start, start[own] + (again["s"].astype(np.int64) - at)[of]], np.r_[length, length[own]]

    def kept(key: tuple[pa.Scalar, ...], text: pa.Table, info: pa.Table) -> pa.Table:
        text = text_of(text)
        row, marks = located(text, info["blob"].to_pylist())
        cut = np.searchsorted(row, np.arange(text.num_rows + 1))
        buf, off = arrow_text(text["text"])
        removed, spans, left = [], [], []
        for i in range(text.num_rows):
            own = buf[off[i] : off[i + 1]]
            start, length = with_copies(marks[cut[i] : cut[i + 1]])
            if len(start):
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if as_text:
                    character = np.cumsum((own & 0xC0) != 0x80) - 1
                    whole = np.zeros(character[-1] + 1, bool)
                    whole[character[gone]] = True
                    gone = whole[character]
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                left.append(own[~gone].tobytes())
            else:
                removed.append(0)
                spans.append(0)
                left.append(own.tobytes())
        kept_column = pa.array(left, pa.binary())
        columns = [text["doc_id"].combine_chunks(), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), kept_column.cast(pa.string()) if as_text else kept_column]
        columns += [text[x].combine_chunks() if text.num_rows else pa.array([], pa.null()) for x in more]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *more])

    def back(df: DataFrame, f) -> DataFrame:
        return df.groupBy("b").applyInArrow(f, BLOB_SCHEMA).select("to", "blob").groupBy("to")

    texts = dealt_text(docs, DEALT).groupBy("to")
    found = docs.select("k", "first", "text").mapInArrow(releasing(anchors), BLOB_SCHEMA)
    found = texts.cogroup(back(found, decided)).applyInArrow(fetched, BLOB_SCHEMA)
    out = texts.cogroup(back(found, indexed)).applyInArrow(kept, schema)
    return out.withColumnsRenamed(dict(zip(more, carried, strict=True)))


def without_repeated_strings(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents with what is left of their texts, and the columns they came with; n_chars, if there, counts anew.

    A character of which only some bytes were removed goes wholly.
    """
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    names = {c: f"carried {i}" for i, c in enumerate(carried)}
    out = remove_repeated_strings(docs.withColumnsRenamed(names), window, carried=tuple(names.values()), as_text=True)
    out = out.select("doc_id", F.col("kept").alias("text"), *[F.col(f"`{n}`").alias(c) for c, n in names.items()])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
