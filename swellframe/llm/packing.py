"""Best-fit packing of tokenised documents into sequences, in hierarchical rounds.

Documents become token ids and an end token; those longer than a sequence are cut into full pieces and a rest.
Pieces are packed best fit, longest first, in each partition. Bins that are nearly full are emitted; the others go, as
items of their filled length, to the next round, where `fan_in` partitions meet in one and are packed again with a wider choice. A
partition holds about ITEMS items in any round. The last round is over all that is left, when that suits one partition or
when a round closes few bins (say, all of them longer than half a sequence): best fit over the counts of each length, at most
`capacity` of them whatever the size, gives the kinds of bins, and items take their places by their rank among those of a length.
A bin that is merged keeps its contents together, so a round moves a row per bin, and pieces find their place by following at
most log(partitions) levels of (bin -> bin, offset).

Tokens come from a public tokenizer file whose path is a parameter. The tokenizer drops white space and never merges across it, so a text's
ids are those of its white-space-delimited chunks: each distinct chunk of a slice of text is looked up in a bounded cache, or given to the tokenizer with
many others, and arrays put the ids in order. A text with a character for which that, or lower-casing in Arrow, could differ goes to the tokenizer whole.

Defined results: null text is empty (its end token is one piece); rows that repeat a doc_id, or have none, are packed as documents
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, releasing, slices, stored

#: Chunks whose ids a worker keeps, in each of two halves: what was used since the last turn, and before it.
CACHE = 75_000
#: Bytes of text that are Python objects at once.
SLICE = 2 << 20
#: Items that one partition packs in the first round, as a target, and partitions that meet in a round.
ITEMS, FAN_IN = 20_000, 8
#: If more than this share of the bins of a round stay open after the next, what remains goes to the last round.
ROUND_CLOSES = 0.7
#: A bin is emitted before the last round if it lacks at most this share of a sequence.
NEARLY_FULL = 0.004
#: Fixed value: how the tokenizer cuts text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Single characters that are words of their own after letters.
MARKS = frozenset(".,;:!?")
#: Where Python's white space or lower case may differ from the tokenizer's, or a special token may stand.
ODD = "\x1c\x1d\x1e\x1fΣİ"
#: Letters below are the same in all versions of Unicode that matter here; a chunk with others goes to the tokenizer whole.
LETTERS_TO = "\u0530"
PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizers_of(path: str):
    """The tokenizer of a file, and one for words that are normalised and cut already; loaded by each task, so that workers don't hold it in other stages."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(path)
    plain = Tokenizer(whole.model)  # the same model, not a copy
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    release()
    return whole, plain


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer, self.plain = tokenizers_of(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learned(self, chunks: list[str]) -> dict[str, bytes]:
        """ids of chunks. Those of letters, and perhaps one mark, are many words of one text, cut after each token that ends a word."""
        simple, texts, words, out = [], [], [], {}
        for c in chunks:
            if c.isalpha() and (c.isascii() or max(c) < LETTERS_TO):
                texts.append(c)
                words.append(1)
            elif c[-1] in MARKS and c[:-1].isalpha() and (c.isascii() or max(c) < LETTERS_TO):
                texts.append(f"{c[:-1]} {c[-1]}")
                words.append(2)
            elif max(c) < LETTERS_TO:
                own = WORDS.findall(c)
                if not own:  # white space that the splitting leaves at the end of a blank text
                    out[c] = b""
                    continue
                texts.append(" ".join(own))
                words.append(len(own))
            else:
                out[c] = self.whole(c)
                continue
            simple.append(c)
        for i in range(0, len(simple), 500):
            ids = np.array(self.plain.encode_batch_fast([" ".join(texts[i : i + 500])], add_special_tokens=False)[0].ids, "<u4")
            ends, last = np.flatnonzero(self.is_end[ids]) + 1, np.cumsum(words[i : i + 500])
            part = simple[i : i + 500]
            if len(ends) == last[-1]:
                data, at = ids.tobytes(), [0, *(4 * ends[last - 1]).tolist()]
                out.update(zip(part, [data[a:b] for a, b in pairwise(at)], strict=True))
            else:
                out.update((c, self.whole(c)) for c in part)
        return out

    def known(self, chunks: list[str]) -> list[bytes]:
        """ids of distinct chunks, of the cache where it has them. What is still in use moves on from the older half."""
        young, old = self.young, self.old
        found = [young.get(c) or old.get(c) for c in chunks]
        new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        made = self.learned(new)
        if len(young) + len(chunks) > CACHE:
            self.old, self.young = young, {}
        self.young.update((c, ids) for c, ids in zip(chunks, found, strict=True) if ids is not None)
        self.young.update(made)
        return [made[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]

    def batch(self, texts: pa.Array) -> list[bytes]:
        rows = [t or "" for t in texts.to_pylist()]
        odd = [any(c in t for c in ODD) or ("<|" in t and any(s in t for s in self.specials)) for t in rows]
        plain = ["" if o else t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t, o in zip(rows, odd, strict=True)]
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(plain, pa.string())))
        chunks = cut.flatten().dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.known([c for c in names if c])
        if "" in names:
            ids.insert(names.index(""), b"")
        of = chunks.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        each = size[of]
        end = np.cumsum(each)
        place = np.repeat((start[of] - (end - each)).astype(np.int32), each) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")[place]
        at = np.r_[0, end][cut.offsets.to_numpy()]
        return [self.whole(t) if o else flat[a:b].tobytes() for t, o, (a, b) in zip(rows, odd, pairwise(at.tolist()), strict=True)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of the input row), piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches):
        encoder = Encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text", SLICE):
            ids, rows, out = part.column("doc_id").to_pylist(), part.column("row").to_pylist(), []
            for i, row, data in zip(ids, rows, encoder.batch(part.column("text")), strict=True):
                data += end
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    out.append((i, row, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).mapInArrow(releasing(cut), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: the bin and the place in it of each item, and how many bins there are."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    count = 0
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room]
            b = own.pop()
            if not own:
                del by_room[room], rooms[at]
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        if room := room - n:
            if room in by_room:
                by_room[room].append(b)
            else:
                by_room[room] = [b]
                insort(rooms, room)
    return bins, offsets, count


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over lengths with counts: slots (length, rank, times, bin, each, offset), and how many bins there are.

    The items of a length with ranks from `rank` on, `times` of them, go to the bins from `bin` on, `each` to a bin, from `offset`.
    Bins of the same contents have consecutive numbers, so there are as many slots as kinds of bins, however many bins.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
    rooms: list[int] = []
    slots, total = [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((first, bins))

    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, first, bins = capacity, total, -(-left // (capacity // n))
                total += bins
            each = min(room // n, left)
            used = min(bins, left // each)
            slots.append((n, rank, used * each, first, each, capacity - room))
            put(room - n * each, first, used)
            put(room, first + used, bins - used)
            rank, left = rank + used * each, left - used * each
    return np.array(slots, np.int64).reshape(-1, 6), total


def ranked(items: DataFrame, parts: int) -> DataFrame:
    """items (item, length) with `rank`, their number among those of the same length, from 0.

    Numbers are given within a length and part; where a part begins comes from the counts of the parts before it.
    """
    own = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    sizes = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("item")) - 1
    return own.withColumn("rank", rank).join(starts, ["length", "part"]).select("item", "length", (F.col("rank") + F.col("before")).alias("rank"))


def pack_by_counts(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """The last round, over any number of items (item, length): item, bin, offset. Only counts by length are gathered, at most `capacity` of them."""
    sizes = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = best_fit_counts(sizes, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    key = slots[:, 0] << 48 | slots[:, 1]

    def placed(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = slots[np.searchsorted(key, length << 48 | rank, "right") - 1]
            step = rank - own[:, 1]
            name = (np.int64(level) << 56) | (own[:, 3] + step // own[:, 4])
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(name), pa.array(own[:, 5] + step % own[:, 4] * length)], names=["item", "bin", "offset"])

    parts = max(1, -(-sum(sizes.values()) // ITEMS))
    return ranked(items, parts).mapInArrow(placed, "item bigint, bin bigint, offset bigint")


def pack(pieces: DataFrame, capacity: int, partitions: int | None = None) -> DataFrame:
    """pieces (item bigint unique, length) -> item, sequence_id, offset."""
    n_open = pieces.count()
    items = partitions or max(1, -(-n_open // ITEMS))

    def packed(level: int):
        enough = capacity * (1 - NEARLY_FULL)

        def of(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            lengths = group["length"].to_numpy()
            bins, offsets, count = best_fit(lengths, capacity)
            filled = np.zeros(count, np.int64)
            np.add.at(filled, bins, lengths)
            name = (np.int64(level) << 56) | (np.int64(key[0].as_py()) << 32) | np.arange(count)
            return pa.table([group["item"].combine_chunks(), pa.array(name[bins]), pa.array(offsets), pa.array(filled[bins]), pa.array((filled >= enough)[bins]), pa.array(offsets == 0)], names=["item", "bin", "offset", "filled", "ready", "opens"])

        return of

    todo = pieces.select("item", "length")
    placed, done, level = None, [], 0
    while True:
        last = level > 0 and (items == 1 or n_open > ROUND_CLOSES * before)
        if last:
            made = pack_by_counts(todo, capacity, level).withColumn("ready", F.lit(True))
        else:
            dealt = todo.withColumn("part", F.pmod(F.hash("item"), F.lit(items)).cast("int"))
            made = stored(dealt.groupBy("part").applyInArrow(packed(level), "item bigint, bin bigint, offset bigint, filled bigint, ready boolean, opens boolean"), f"round{level}")
        if placed is None:
            placed = made.select("item", "bin", "offset", "ready")
        else:
            outer = made.select(F.col("item").alias("inner"), F.col("bin").alias("outer"), F.col("offset").alias("shift"), "ready")
            placed = placed.join(outer, placed["bin"] == outer["inner"])
            placed = stored(placed.select("item", F.col("outer").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), "ready"), f"placed{level}")
        done.append(placed.where("ready").select("item", F.col("bin").alias("sequence_id"), "offset"))
        if last:
            return reduce(DataFrame.unionByName, done)
        placed = placed.where("not ready").select("item", "bin", "offset")
        todo = made.where("opens and not ready").select(F.col("bin").alias("item"), F.col("filled").alias("length"))
        before, n_open = n_open, todo.count()
        items, level = max(-(-items // FAN_IN), -(-n_open // ITEMS)), level + 1


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece."""
    found = stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    found = stored(found.withColumn("item", F.monotonically_increasing_id()), "items")
    places = pack(found, capacity, partitions)
    return found.join(places, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
