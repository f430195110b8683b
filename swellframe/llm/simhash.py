"""SimHash near-duplicates: exact pairs at a small Hamming distance by a forest of vantage-point trees.

A document's fingerprint has a bit for each of 64 positions: 1 where more than half of its shingle hashes have it.
Documents link where their fingerprints differ in at most `radius` bits; classes are the components of the links.

* Equal fingerprints collapse first (a grouped minimum, pre-aggregated), so exact copies cost nothing later.
* Random fingerprints lie close to 32 bits from any point, so one tree over all 64 bits prunes little at radius 4. The bits
  are therefore cut into `blocks` (3): of two fingerprints within `radius`, some block differs in at most
  radius // blocks bits (1). Each block has a tree over the distance of its bits, which never exceeds the whole distance.
* A tree's node holds a vantage point v and a bound m: inside if d(x, v) <= m. By the triangle inequality a query at
  radius r needs the inside only if d <= m + r, the outside only if d > m - r. A fingerprint is stored in the leaf it
  falls into and queries the other leaves within reach (those after its own; the pair meets there once). Trees are
  built from a bounded sample of fingerprints; the sample only shapes the tree, every fingerprint is routed.
* A leaf that the sample shows to be large is cut into parts by hash; its rows query each part.
* From MANY distinct fingerprints on, radius 1 on narrow blocks would make rows query ever more leaves. Trees then look at wider masks, two or three
  of more blocks, at radius 0: no row is near a boundary, large leaves are cut by the masked bits, and a row has 15 or 35 copies at any size.
* In a leaf, distances are computed in blocks. Where few pairs link, they are emitted; in a dense leaf the links are
  followed breadth first and only a spanning tree is emitted, so a group of near copies never yields all its pairs.

Defined results: null or blank texts have fingerprint zero and link like any other; rows may repeat a doc_id or have none (a class with no
doc_id has a null component_id); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealt, mix, releasing, stored, unpack

#: Fingerprints that shape the trees.
SAMPLE = 1 << 15
#: Fingerprints that a leaf should hold, and that a part of a large leaf may hold.
LEAF, LEAF_PART = 1500, 24000
#: Distinct fingerprints from which trees look at equal bits of wider masks.
MANY = 50_000_000
#: Texts that are Python objects at once.
SLICE_ROWS = 1000
#: Vantage points tried for a node.
TRIED = 12
POINT = np.dtype([("x", "<u8"), ("home", "u1")])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text, A-Z lower-cased; fewer words than a shingle are one, none have none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    n = len(words) - shingle + 1
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 without words."""
    h = shingle_hashes(text, shingle)
    n = len(h)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint."""

    def of(batches):
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(of), "doc_id bigint, fp bigint")


class Tree:
    """A vantage-point tree over the bits of a mask; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf_size: float, rng):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, bound, inside, outside; a leaf is ~number
        self.shares: list[int] = []
        self.root = self._grow(sample, leaf_size, 0, rng)

    def distance(self, x: np.ndarray, v: int) -> np.ndarray:
        return np.bitwise_count((x ^ np.uint64(v)) & self.mask).astype(np.int16)

    def _grow(self, own: np.ndarray, leaf_size: float, depth: int, rng) -> int:
        best = None
        if len(own) > max(leaf_size, 8) and depth < 24:
            for v in rng.choice(own, min(TRIED, len(own)), replace=False):
                d = self.distance(own, v)
                for m in np.unique(np.quantile(d, (0.35, 0.5, 0.65)).astype(int)):
                    inside, outside = np.count_nonzero(d <= m + self.radius), np.count_nonzero(d > m - self.radius)
                    home = np.count_nonzero(d <= m)
                    if 0.15 * len(own) <= home <= 0.85 * len(own):
                        cost = inside * home + outside * (len(own) - home)
                        if best is None or cost < best[0]:
                            best = (cost, int(v), int(m), d <= m)
            if best and best[0] > 0.9 * len(own) ** 2:
                best = None
        if best is None:
            self.shares.append(len(own))
            return ~(len(self.shares) - 1)
        at = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        inside = self._grow(own[best[3]], leaf_size, depth + 1, rng)
        outside = self._grow(own[~best[3]], leaf_size, depth + 1, rng)
        self.nodes[at] = (best[1], best[2], inside, outside)
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's own) of every leaf that a row is stored in or queries."""
        out, todo = [], [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), ~node), home))
                continue
            v, m, inside, outside = self.nodes[node]
            d = self.distance(x[rows], v)
            near, far = d <= m + self.radius, d > m - self.radius
            todo.append((inside, rows[near], home[near] & (d[near] <= m)))
            todo.append((outside, rows[far], home[far] & (d[far] > m)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def links_within(home: np.ndarray, guests: np.ndarray, radius: int) -> np.ndarray:
    """Edges (a, b) that connect what links of home with home, and of home with guests, connect."""
    every = np.concatenate([home, guests])
    found, total = [], 0
    step = max(1, (1 << 21) // max(1, len(every)))
    for i in range(0, len(home), step):
        a, b = np.nonzero(np.bitwise_count(home[i : i + step, None] ^ every[None, i:]) <= radius)
        ok = b > a
        total += int(ok.sum())
        if total > 4 * len(every) + 1000:
            return _spanning(home, guests, radius)
        found.append(np.stack([home[i + a[ok]], every[i + b[ok]]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def _spanning(home: np.ndarray, guests: np.ndarray, radius: int) -> np.ndarray:
    """The same connections as a forest, breadth first. Home rows look at all that is not reached yet, guests at home rows."""
    edges = []
    left_home, left_guests = home, guests
    while len(left_home):
        frontier, left_home = [(left_home[0], True)], left_home[1:]
        while frontier:
            x, is_home = frontier.pop()
            near = np.bitwise_count(left_home ^ x) <= radius
            new = [(y, True) for y in left_home[near]]
            left_home = left_home[~near]
            if is_home:
                near = np.bitwise_count(left_guests ^ x) <= radius
                new += [(y, False) for y in left_guests[near]]
                left_guests = left_guests[~near]
            edges += [(x, y) for y, _ in new]
            frontier += new
    return np.array(edges, np.uint64).reshape(-1, 2)


def masks_for(total: int, radius: int, blocks: int = 3) -> tuple[list[int], int]:
    """Bits that a tree looks at, for each tree, and the radius at which it does, for so many distinct fingerprints.

    Few: `blocks` blocks of bits; of two fingerprints within the radius some block differs in at most radius // blocks bits. From MANY
    on: radius + j blocks, of which j are equal; a tree for each choice of j, at radius 0. Wider masks make up for more fingerprints.
    """
    cut = lambda n: [((1 << (64 * (i + 1) // n)) - (1 << (64 * i // n))) for i in range(n)]
    if total < MANY or radius == 0:
        return cut(blocks), radius // blocks
    j = 2 + int(total >= 200 * MANY)
    return [sum(own) for own in combinations(cut(radius + j), j)], 0


def planned(sample: np.ndarray, total: int, radius: int, blocks: int = 3) -> tuple[list[Tree], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Trees, how many parts each leaf has, whether parts are dealt at random (each row then queries all), and the number of a leaf's first part."""
    masks, r = masks_for(total, radius, blocks)
    rng = np.random.default_rng(3)
    trees = [Tree(sample, m, r, LEAF * len(sample) / max(total, 1), rng) for m in masks]
    each, salted, first, at = [], [], [], 0
    weight = total / max(1, len(sample))
    for t in trees:
        each.append(np.array([max(1, -(-int(s * weight) // LEAF_PART)) for s in t.shares]))
        dense = np.zeros(len(t.shares), bool)
        if r == 0 and len(sample):  # equal bits stay together, unless these are a part's worth or more
            row, leaf, _ = t.route(sample)
            value, n = np.unique(np.stack([leaf.astype(np.uint64), sample[row] & t.mask], axis=1), axis=0, return_counts=True)
            dense[value[(n > 1) & (n * weight > LEAF_PART), 0].astype(np.int64)] = True
        salted.append(dense if r == 0 else np.ones(len(t.shares), bool))
        first.append(at + np.concatenate([[0], np.cumsum(each[-1])]))
        at = int(first[-1][-1])
    return trees, each, salted, first


def dealt_out(x: np.ndarray, plan) -> tuple[np.ndarray, np.ndarray]:
    """Records of fingerprints, and the leaf parts that each goes to: one is its home in a tree, in the others it is a query."""
    recs, to = [], []
    for tree, parts, salted, base in zip(*plan, strict=True):
        row, leaf, own = tree.route(x)
        home_leaf = np.empty(len(x), np.int64)
        home_leaf[row[own]] = leaf[own]
        later = own | (leaf > home_leaf[row])
        row, leaf, own = row[later], leaf[later], own[later]
        salt = (np.where(salted[leaf], x[row], mix(x[row] & tree.mask)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        part = salt % parts[leaf]
        many = np.where(salted[leaf], parts[leaf], 1)
        copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, leaf, own, part = (np.repeat(c, many) for c in (row, leaf, own, part))
        copy = np.where(salted[leaf], copy, part)
        ok = ~own | (copy >= part)
        rec = np.empty(int(ok.sum()), POINT)
        rec["x"], rec["home"] = x[row[ok]], own[ok] & (copy == part)[ok]
        recs.append(rec)
        to.append(base[leaf[ok]] + copy[ok])
    return np.concatenate(recs), np.concatenate(to)


def near_links(distinct: DataFrame, radius: int = 4, blocks: int = 3) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct.fp within radius."""
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    plan = planned(np.array(sample, np.int64).view(np.uint64), distinct.count(), radius, blocks)

    def routed(batches):
        for batch in batches:
            ids, blobs = dealt(*dealt_out(batch.column(0).to_numpy().view(np.uint64), plan))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["leaf", "blob"])

    def linked(group: pa.Table) -> pa.Table:
        rec = unpack(group["blob"].to_pylist(), POINT)
        pairs = links_within(rec["x"][rec["home"] == 1], rec["x"][rec["home"] == 0], radius)
        pairs = np.unique(pairs, axis=0).view(np.int64) if len(pairs) else pairs.view(np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return distinct.select("fp").mapInArrow(releasing(routed), "leaf int, blob binary").groupBy("leaf").applyInArrow(linked, "a bigint, b bigint")


def classes(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach), a row per input row."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = stored(named.join(least, "root").select("fp", "component_id"), "owner")
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")


def hexed(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
