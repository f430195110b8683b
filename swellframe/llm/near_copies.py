"""Near copies of the pipeline: links of five-word Jaccard similarity >= 0.8, proposed by long SimHash fingerprints and checked on the sets.

Nodes are distinct sets of shingles (hash of the sorted set); exact copies collapse into one. Two sets of similarity 0.8 differ in about 15 % of
their SimHash bits, random ones in half. No radius on 64 bits tells these apart and still prunes, so fingerprints are longer:

* Search: as in simhash, blocks of the fingerprint have a vantage-point tree each. A fingerprint is stored in its leaf of a tree, and queries the
  leaves that may hold one within the tree's radius (1) on the block. There are as many trees as bring a pair at 0.8 within that
  radius in some block with probability RECALL (12 of 12 bits for 256,000 documents); a closer pair is missed more rarely. From MANY documents on,
  radius 1 would query ever more leaves, and more trees are searched at radius 0.
* Those found are compared on 192 further bits, other ones from tree to tree, and proposed if they differ in few (RADIUS), which random pairs do
  not. Only these bits travel with a fingerprint's block, never the whole signature. Where a component of these is dense, no pairs are proposed: its
  rows are named as a group, with a record each. Groups that share a row, in whatever leaf, are one, and all pairs of a group are decided by the sets
  themselves (`classes_of`), which meet once for each pair of blocks of a group.
* Sets of few shingles have few votes, so that their fingerprints scatter more. Beside the search they also meet by prefixes: of a set of n shingles in
  hash order the first n - ceil(0.8 n) + 1, one of which any pair at 0.8 shares.
* Every proposal is checked by the exact sets, and the classes are the components of those that hold and of the groups' links. Before the sets of a pair meet, their bitmaps
  (a fortieth of the bytes) and sizes do: they bound what two sets share from above, so that only pairs that cannot have the similarity go.

Defined results: A-Z lower-cased, words between white space; a text of fewer words than a shingle is one shingle, blank and null texts are
copies of each other; rows may repeat a doc_id or have none (see `first_of_each`); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealt, mix, releasing, runs, slices, stored, text_key, unpack, without_rows
from .simhash import Tree, shingle_hashes

#: Fixed values of the stage.
SHINGLE, SIMILARITY = 5, 0.8
#: Probability that a pair at SIMILARITY is within the radius in some block.
RECALL = 0.999
#: 64-bit words of further bits, and what a proposed pair may differ in for every two of them (so 55 of 192; pairs at 0.8: 29.1 +- 5.0, small sets
#: 36 +- 5.4, random ones 96 +- 6.9).
WORDS, RADIUS = 3, 37
#: Fingerprints that a leaf should hold, that a part of a large leaf may hold, and that shape the trees.
LEAF, LEAF_PART, SAMPLE = 12000, 32000, 1 << 14
#: Documents from which trees are searched at radius 0.
MANY = 1 << 20
#: Sets meet by prefixes too if SIMILARITY times their shingles are at most as many.
FEW = 32
#: Components propose all their pairs if they have this size at most, or DENSE pairs for each row; the others become groups.
SHORT_RUN, DENSE = 16, 3
#: Hashes of the sets that a block of a group should hold, and sets that are compared with one at once.
BLOCK, AT_ONCE = 1 << 19, 256
#: Bytes of text that are Python objects at once.
SLICE = 1 << 20
BY_PREFIX = np.dtype([("slot", "<u8"), ("node", "<i8"), ("bits", "<u8", (WORDS,))])
#: Records of a leaf: a fingerprint's block there, whether the leaf is its home, and its further bits.
MET = np.dtype([("block", "<u4"), ("home", "u1"), ("node", "<i8"), ("bits", "<u8", (WORDS,))])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(shingle_hashes((text or "").encode(), SHINGLE))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def forest_for(n: int) -> tuple[int, int, int]:
    """Bits of a block, how many blocks (a tree each), and the radius of their search, for n documents."""
    radius = int(n < MANY)
    depth = math.log2(max(2, n / LEAF))
    width = max(12, math.ceil(2 * depth)) if radius else min(32, math.ceil(depth) + 5)
    differ = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    within = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(radius + 1))
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - within)), radius


def signature(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` times 64 bits of SimHash: each bit that of the majority of the set's hashes, mixed anew for each word."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):  # sums of 255 fit a byte
        drawn = mix(hashes[i : i + 255, None] + salts)
        votes += np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def blocks_of(bits: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first `count` blocks of `width` bits of each signature, a number each."""
    each = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, : width * count]
    return each.reshape(len(bits), count, width) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Of a small set, the hashes one of which any set of SIMILARITY shares; of others none."""
    n = len(hashes)
    return hashes[: n - math.ceil(SIMILARITY * n - 1e-9) + 1 if n * SIMILARITY <= FEW else 0]


def prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, of_text, node, bits (of the whole signature), prefix (of sets that meet by it)."""

    def of(batches):
        for batch in slices(batches, "text", SLICE):
            node, bits, first = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_set(text)
                node.append(node_of(h))
                bits.append(signature(h, words).tobytes())
                first.append(prefix(h).tobytes())
            columns = [batch.column("doc_id"), batch.column("of_text"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "of_text", "node", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), text_key().alias("of_text"), "text").mapInArrow(releasing(of), "doc_id bigint, of_text bigint, node bigint, bits binary, prefix binary")


def words_of(rec: np.ndarray) -> list[np.ndarray]:
    """The further bits of records, an array for each word."""
    return [rec["bits"][:, i].copy() for i in range(WORDS)]


def apart(words, rows, others) -> np.ndarray:
    """Hamming distances of rows from others, a row of the result for each of rows."""
    return sum(np.bitwise_count(w[rows, None] ^ w[others]).astype(np.int16) for w in words)


def reach(words) -> int:
    """Bits that rows of so many words may differ in."""
    return RADIUS * len(words) // 2


def tree_within(*words_and_radius) -> list[tuple[int, int]]:
    """Edges of length up to radius of a minimum spanning tree over the Hamming distances of rows of one or more words. The last argument is the radius."""
    *words, radius = words_and_radius
    n = len(words[0])
    far = 64 * len(words) + 1
    near = np.full(n, far, np.int16)
    via = np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        left[at] = False
        d = apart(words, [at], slice(None))[0]
        closer = left & (d < near)
        near[closer], via[closer] = d[closer], at
        at = int(np.argmin(np.where(left, near, far + 1)))
        if near[at] <= radius:
            out.append((int(via[at]), at))
    return out


def pairs_of(*words: np.ndarray) -> tuple[np.ndarray, bool]:
    """Pairs of rows within reach, and whether it is all of them; of many rows with more than DENSE for each, those of a spanning tree, which only
    tell the rows that belong together: these become a group."""
    n = len(words[0])
    found, total = [], 0
    block = max(1, (1 << 18) // n)
    for i in range(0, n, block):
        a, b = np.nonzero(np.triu(apart(words, slice(i, i + block), slice(i, None)) <= reach(words), 1))
        total += len(a)
        found.append(np.stack([i + a, i + b], axis=1))
        if n > SHORT_RUN and total > DENSE * n:
            return np.array(tree_within(*words, reach(words)), np.int64).reshape(-1, 2), False
    return np.concatenate(found), True


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components after rows a and b are joined; the label of each is that of a row of its component."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def components(own: np.ndarray, *rest) -> list[np.ndarray]:
    """Rows of each component of two or more, for (own, words, how many rows are at home, radius).

    Links are those of the rows at home (the first ones) with each other and with the rest: blocks (own) within radius (0 or 1), and the further
    bits within reach. Rows at home, and the rest, are in the order of their blocks, so that each block meets only those that it can link to.
    """
    *words, homes, radius = rest
    label = np.arange(len(own))
    value, start = np.unique(own[:homes], return_index=True)
    ends = np.r_[start[1:], homes]
    flips = np.r_[0, (1 << np.arange(32))[: 32 * radius]].astype(np.uint32)
    found, size = [], 0
    for v, s, e in zip(value, start.tolist(), ends.tolist(), strict=True):
        ball = v ^ flips
        at = np.flatnonzero(np.isin(value, ball[ball > v]))
        low, high = (homes + np.searchsorted(own[homes:], ball, side) for side in ("left", "right"))
        spans = zip(np.r_[s, start[at], low].tolist(), np.r_[e, ends[at], high].tolist(), strict=True)
        others = np.concatenate([np.arange(i, j) for i, j in spans if i < j])  # its own come first
        block = max(1, (1 << 18) // len(others))
        for i in range(s, e, block):
            a, b = np.nonzero(apart(words, slice(i, min(i + block, e)), others[i - s :]) <= reach(words))
            a, b = i + a, others[i - s :][b]
            found.append((a[a < b], b[a < b]))
            size += len(found[-1][0])
            if size > 1 << 18:
                label, found, size = joined(label, *map(np.concatenate, zip(*found, strict=True))), [], 0
    if found:
        label = joined(label, *map(np.concatenate, zip(*found, strict=True)))
    order = np.argsort(label, kind="stable")
    return [rows for rows in np.split(order, runs(label[order])[1:]) if len(rows) > 1]


def named(node: np.ndarray, rows: np.ndarray, pairs: np.ndarray, every: bool) -> np.ndarray:
    """What `pairs_of` found among rows, as nodes: pairs to be checked as (a, b) with a < b; for those of a group (its other rows, its smallest)."""
    if every:
        return np.sort(node[rows[pairs]], axis=1)
    label = joined(np.arange(len(rows)), *pairs.T)
    order = np.lexsort((node[rows], label))
    start = runs(label[order])
    least = np.repeat(node[rows[order[start]]], np.diff(np.r_[start, len(order)]))
    own = node[rows[order]]
    return np.stack([own, least], axis=1)[own > least]


def all_named(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def proposed(rec: np.ndarray, radius: int, _leaf: int | None = None) -> np.ndarray:
    """What a leaf proposes: (a, b) with a < b are pairs of nodes; with a > b, a is in a group with b. The leaf's number is not needed."""
    rec = rec[np.lexsort((rec["node"], rec["block"], 1 - rec["home"]))]
    words = words_of(rec)
    return all_named([named(rec["node"], c, *pairs_of(*(w[c] for w in words))) for c in components(rec["block"].copy(), *words, int(rec["home"].sum()), radius)])


def proposed_by_prefix(rec: np.ndarray) -> np.ndarray:
    """The same of those that share a hash of their prefixes."""
    rec = rec[np.lexsort((rec["node"], rec["slot"]))]
    words = words_of(rec)
    start = runs(rec["slot"])
    n = np.diff(np.r_[start, len(rec)])
    meet = zip(start[n > 1].tolist(), (start + n)[n > 1].tolist(), strict=True)
    return all_named([named(rec["node"], np.arange(a, b), *pairs_of(*(w[a:b] for w in words))) for a, b in meet])


class Forest:
    """A vantage-point tree over each block, shaped by a sample of fingerprints; the leaves of all trees are numbered, large ones in parts."""

    def __init__(self, sample: np.ndarray, total: int, width: int, count: int, radius: int):
        self.width, self.count = width, count
        rng = np.random.default_rng(3)
        own = LEAF * len(sample) / max(1, total)
        self.trees = [Tree(np.ascontiguousarray(x), (1 << width) - 1, radius, own, rng) for x in blocks_of(sample, width, count).T]
        weight = total / max(1, len(sample))
        self.parts = [np.array([max(1, -(-int(s * weight) // LEAF_PART)) for s in t.shares]) for t in self.trees]
        ends = np.cumsum([p.sum() for p in self.parts])
        self.first = [end - p.sum() + np.cumsum(p) - p for end, p in zip(ends, self.parts, strict=True)]

    def further(self, tree: int, words: int) -> list[int]:
        """Words of a signature that a tree's leaves compare: none that its block is in, and not the same ones in all trees."""
        first, last = tree * self.width // 64, ((tree + 1) * self.width - 1) // 64
        others = [w for w in range(words) if not first <= w <= last]
        return [others[(tree + i) % len(others)] for i in range(WORDS)]

    def dealt_out(self, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records, and the leaf part that each goes to: one is a fingerprint's home in a tree, in the others it is a query.

        Of two within the radius, the one whose home comes first queries the other's. Rows of a leaf in parts also query the parts after their own.
        """
        recs, to = [], []
        salt = (mix(node.view(np.uint64)) >> np.uint64(40)).astype(np.int64)
        for i, (tree, parts, first, x) in enumerate(zip(self.trees, self.parts, self.first, blocks_of(bits, self.width, self.count).T, strict=True)):
            row, leaf, own = tree.route(np.ascontiguousarray(x))
            home = np.empty(len(x), np.int64)
            home[row[own]] = leaf[own]
            later = leaf >= home[row]
            row, leaf, own = row[later], leaf[later], own[later]
            many = parts[leaf]
            copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, leaf, own = (np.repeat(c, many) for c in (row, leaf, own))
            part = salt[row] % parts[leaf]
            ok = ~own | (copy >= part)
            rec = np.empty(int(ok.sum()), MET)
            rec["block"], rec["node"], rec["bits"], rec["home"] = x[row[ok]], node[row[ok]], bits[:, self.further(i, bits.shape[1])][row[ok]], (own & (copy == part))[ok]
            recs.append(rec)
            to.append(first[leaf[ok]] + copy[ok])
        return np.concatenate(recs), np.concatenate(to)


def signatures_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def candidates(distinct: DataFrame, width: int, count: int, radius: int) -> DataFrame:
    """(a, b): the proposed pairs of nodes (a < b), and who is in a group with whom (a > b)."""
    total = distinct.count()
    sample = [r["bits"] for r in distinct.orderBy(F.xxhash64("node"), "node").select("bits").limit(SAMPLE).collect()]
    if not sample:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b"))
    forest = Forest(signatures_of(sample), total, width, count, radius)
    buckets = max(1, -(-total // 2000))

    def routed(batches):
        for batch in batches:
            if batch.num_rows:
                ids, blobs = dealt(*forest.dealt_out(batch.column("node").to_numpy(), signatures_of(batch.column("bits").to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["leaf", "blob"])

    def by_slot(batches):
        for batch in batches:
            hashes = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            bits = signatures_of(batch.column("bits").to_pylist())
            row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            rec = np.empty(len(row), BY_PREFIX)
            if len(row):
                rec["slot"] = mix(np.concatenate(hashes) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                rec["node"], rec["bits"] = batch.column("node").to_numpy()[row], bits[row, -WORDS:]
            ids, blobs = dealt(rec, ((rec["slot"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    as_table = lambda p: pa.table([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    def in_leaf(group: pa.Table) -> pa.Table:
        return as_table(proposed(unpack(group["blob"].to_pylist(), MET), radius))

    def in_bucket(group: pa.Table) -> pa.Table:
        return as_table(proposed_by_prefix(unpack(group["blob"].to_pylist(), BY_PREFIX)))

    by_forest = distinct.select("node", "bits").mapInArrow(releasing(routed), "leaf int, blob binary").groupBy("leaf").applyInArrow(in_leaf, "a bigint, b bigint")
    small = distinct.where(F.length("prefix") > 0).select("node", "bits", "prefix")
    by_prefix = small.mapInArrow(releasing(by_slot), "bucket int, blob binary").groupBy("bucket").applyInArrow(in_bucket, "a bigint, b bigint")
    return by_forest.unionByName(by_prefix).distinct()


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each value of the last bits of the hashes, of which there are two to four times as many as hashes."""
    size = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    has = np.zeros(size, bool)
    has[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(has, bitorder="little").tobytes()


def shared_at_most(x: bytes, n: int, y: bytes, m: int) -> int:
    """What two sets of n and m can share at most: a bit that only one bitmap has is an element that only one set has."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size = 8 * min(len(x), len(y))
    for at in range((8 * max(len(x), len(y)) // size).bit_length() - 2, -1, -1):  # the longer is folded, halves on each other
        half = size << at
        a, b = a >> half | a & (1 << half) - 1, b >> half | b & (1 << half) - 1
    return min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())


def sets_of(docs: DataFrame) -> DataFrame:
    """node, sh (the set of shingles), n (how many) and map (its bitmap) of each document."""

    def of(batches):
        for batch in slices(batches, "text", SLICE):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            node = pa.array(np.array([node_of(h) for h in sets], np.uint64).view(np.int64))
            columns = [node, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([len(h) for h in sets], pa.int64()), pa.array([bitmap(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "sh", "n", "map"])

    return docs.select("text").mapInArrow(releasing(of), "node bigint, sh array<bigint>, n bigint, map binary")


def joined_with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of both of their sets, those of a as a_..., those of b as b_..."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
    return pairs


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sizes and bitmaps allow SIMILARITY; none that has it goes."""

    def of(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_map", "a_n", "b_map", "b_n")), strict=True)
            allowed = [similar(shared_at_most(x, n, y, m), n, m) for x, n, y, m in rows]
            yield batch.select(["a", "b"]).filter(pa.array(allowed, pa.bool_()))

    return joined_with(pairs, sets, "map", "n").mapInArrow(releasing(of), "a bigint, b bigint")


def similar(shared, n, m):
    """Whether sets of n and m that share so many have SIMILARITY."""
    return shared >= SIMILARITY * (n + m - shared) - 1e-9


def joined_if_similar(label: np.ndarray, a: np.ndarray, b: np.ndarray, token: np.ndarray, off: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Labels after those of pairs (a, b; sorted by a) that have SIMILARITY are joined. has: room for a flag of each token, all unset."""
    if not len(a):
        return label
    size = np.diff(off)
    start = runs(a)
    hold = np.zeros(len(a), bool)
    for s, e in zip(start.tolist(), np.r_[start[1:], len(a)].tolist(), strict=True):
        i, others = a[s], b[s:e]
        own = token[off[i] : off[i + 1]]
        has[own] = True
        at = np.repeat(off[others] - np.r_[0, np.cumsum(size[others])[:-1]], size[others]) + np.arange(size[others].sum())
        shared = np.bincount(np.repeat(np.arange(len(others)), size[others]), has[token[at]], len(others))
        has[own] = False
        hold[s:e] = similar(shared, size[i], size[others])
    return joined(label, a[hold], b[hold])


def classes_of(hashes: np.ndarray, off: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each set (hashes[off[i]:off[i + 1]]) the label of its class: the components of all pairs of SIMILARITY from the two sides, or of one if there is one.

    Of two sets of SIMILARITY the rarest n - ceil(0.8 n) + 1 hashes have one in common. First those that follow each other in the list of such a hash are
    compared, then, in the lists that still have several classes, all sets of different classes.
    """
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    _, token, many = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(len(many))
    token = rank[token]
    token = token[np.lexsort((token, row))]
    first = np.arange(len(token)) - off[row] < (size - np.ceil(SIMILARITY * size - 1e-9) + 1)[row]
    order = np.flatnonzero(first)[np.argsort(token[first], kind="stable")]
    listed, of = token[order], row[order]
    has = np.zeros(len(many), bool)
    label = np.arange(len(size))

    follow = np.flatnonzero(listed[1:] == listed[:-1])
    near = np.unique(np.stack([of[follow], of[follow + 1]], axis=1), axis=0)
    label = joined_if_similar(label, near[:, 0], near[:, 1], token, off, has)

    start = runs(listed)
    length = np.diff(np.r_[start, len(listed)])
    if not len(start):
        return label
    several = np.minimum.reduceat(label[of], start) < np.maximum.reduceat(label[of], start)
    begin, end = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
    begin[listed[start]], end[listed[start]] = start, np.where(several, start + length, start)
    both = side.min() < side.max() if len(side) else False
    for i in range(len(size)):
        lists = token[off[i] : off[i + 1]][first[off[i] : off[i + 1]]]
        lists = lists[end[lists] > begin[lists]]
        if not len(lists):
            continue
        others = np.unique(np.concatenate([of[begin[x] : end[x]] for x in lists.tolist()]))
        others = others[(others < i) & (np.minimum(size[others], size[i]) >= SIMILARITY * np.maximum(size[others], size[i]) - 1e-9)]
        others = others[side[others] != side[i]] if both else others
        while len(others := others[label[others] != label[i]]):
            now, others = others[:AT_ONCE], others[AT_ONCE:]
            label = joined_if_similar(label, np.full(len(now), i), now, token, off, has)
    return label


def links_of_groups(together: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect in each group what its pairs of SIMILARITY connect. together: (a, b), nodes of a group. sets: as of `sets_of`, a row for each node.

    A group's sets are dealt to blocks of about BLOCK hashes, and each two blocks (and each with itself) meet in a task.
    """
    roots = stored(connected_components(together), "groups")
    blocks = roots.join(sets.select("node", "n"), "node").groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = stored(roots.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))), "placed")
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    met = other.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", (F.col("own") > F.col("other")).alias("side"))

    def in_blocks(group: pa.Table) -> pa.Table:
        sh = group["sh"].combine_chunks()
        label = classes_of(sh.flatten().to_numpy(), np.r_[0, np.cumsum(sh.value_lengths().to_numpy())], group["side"].to_numpy())
        node = group["node"].to_numpy()
        rest = label != np.arange(len(label))
        return pa.table([pa.array(node[label[rest]]), pa.array(node[rest])], names=["a", "b"])

    return met.join(sets.select("node", "sh"), "node").groupBy("root", "i", "j").applyInArrow(in_blocks, "a bigint, b bigint")


def links(docs: DataFrame, distinct: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(a, b): the proposed pairs whose sets have SIMILARITY, and what connects those of the groups."""
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = stored(candidates(distinct, *shape), "proposed")
    pairs, together = found.where("a < b"), found.where("a > b")
    nodes = ends(found)
    owners = stored(distinct.join(nodes, "node").select(F.col("least.doc_id").alias("least")), "owners")
    asked = docs.join(owners.distinct(), F.col("doc_id").cast("bigint").eqNullSafe(F.col("least")), "left_semi")
    sets = stored(sets_of(asked).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    left = stored(possible(pairs, sets), "possible")
    both = joined_with(left, sets.join(ends(left), "node", "left_semi"), "sh", "n")
    shared = F.size(F.array_intersect("a_sh", "b_sh"))
    held = both.where(similar(shared, F.col("a_n"), F.col("b_n"))).select("a", "b")
    return held if together.isEmpty() else held.unionByName(links_of_groups(together, sets))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, of_text (hash of the text), component_id (the smallest doc_id that links reach) and first (that document's of_text), a row per input row."""
    width, count, _ = shape = forest_for(docs.count())
    found = stored(prints(docs, -(-count * width // 64) + 2), "prints")
    each = [F.first(c).alias(c) for c in ("bits", "prefix")]  # equal in all rows of a node
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "of_text"))).alias("least")
    distinct = stored(found.groupBy("node").agg(least, *each), "nodes")
    roots = connected_components(links(docs, distinct, shape))
    named = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    owner = stored(named.join(first, "root").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.of_text").alias("first")), "owner")
    return found.select("doc_id", "of_text", "node").join(owner, "node").drop("node")


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the document with the smallest doc_id, with the columns it came with.

    Rows go one by one: those that share a doc_id are told apart by their texts, and of several with the smallest doc_id in a class, one with the
    smallest hash of its text stays. Rows that repeat a doc_id and its text are one document, of which one row stays. Rows without a doc_id go
    where their class has one with a doc_id, and stay otherwise.
    """
    found = stored(classes(docs), "classes")
    others = found.where("component_id is not null and (doc_id is null or doc_id > component_id or of_text > first)")
    kept = without_rows(docs, stored(others.select("doc_id", "of_text"), "others"))
    again = stored(found.where("doc_id = component_id and of_text = first").groupBy("doc_id", "of_text").count().where("count > 1").select("doc_id", "of_text"), "again")
    if again.limit(1).isEmpty():
        return kept
    rows = kept.withColumn("of text", text_key())
    own = again.select(F.col("doc_id").alias("own id"), F.col("of_text").alias("own text"))
    several = rows.join(own, (F.col("doc_id") == F.col("own id")) & (F.col("of text") == F.col("own text")), "left_semi")
    return without_rows(kept, again).unionByName(several.dropDuplicates(["doc_id", "of text"]).select(*kept.columns))
