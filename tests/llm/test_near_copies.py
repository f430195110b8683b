"""The near-copy stage of the pipeline against brute force over five-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from swellframe.llm import near_copies

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted(seed=7):
    """Texts, and pairs (i, j) with their similarity: half of them 0.8 to 0.95, some just below; sizes from 8 to 600 words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    texts, pairs = [], []
    for i in range(450):
        w = [word() for _ in range(r.choice([9, 14, 25, 36, 45, 60, 120, 300, 600]))]
        own = shingles(" ".join(w))
        copy = list(w)
        for _ in range(60):
            at = r.randrange(len(copy))
            changed = copy[:at] + [word()] + copy[at + 1 :] if r.random() < 0.7 else copy[:-1]
            if similarity(own, shingles(" ".join(changed))) < (0.7 if i % 5 == 0 else 0.8):
                break
            copy = changed
            if i % 3 == 0 and similarity(own, shingles(" ".join(copy))) < 0.9:
                break
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(copy).upper()]
    return texts, pairs


def test_planted_pairs(spark):
    texts, pairs = planted()
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    close = {(i, j): similarity(shingles(texts[i]), shingles(texts[j])) for i, j in pairs}
    want = {p for p, s in close.items() if s >= 0.8}
    found = {p for p in want if p[1] not in kept}
    assert {i for i, _ in pairs} <= kept and {j for (i, j), s in close.items() if s < 0.8} <= kept
    at = [s for p, s in close.items() if p in want and s <= 0.95]
    assert len(at) > 200 and len(found) >= 0.98 * len(want)
    assert all(p in found for p in want if len(shingles(texts[p[1]])) <= near_copies.FEW)  # prefixes lose nothing


def test_dense_group_and_odd_rows(spark):
    """More near copies of one text than a short run, blanks, copies, a repeated and a missing doc_id."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join(w for k, w in enumerate(base) if k not in {r.randrange(300) for _ in range(2)})) for i in range(10, 310)]
    rows += [(400, None), (401, " "), (402, "one two"), (403, "One  TWO"), (None, "one two"), (404, "other"), (404, "different")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert near_copies.classes(df).count() == len(rows)
    kept = sorted((x["doc_id"] or -1) for x in near_copies.first_of_each(df).collect())
    assert kept == [10, 400, 402, 404, 404]
    assert near_copies.first_of_each(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Only rows go, not all rows of an id; of rows that are the same one stays."""
    t, other = "a text of several words that others copy", "quite another text that nobody else has here"
    rows = [(1, t), (5, t), (5, other), (7, "seven has this one twice over, word for word"), (7, "seven has this one twice over, word for word"), (None, other), (None, "no id and no copies"), (9, t + " "), (9, t)]
    kept = near_copies.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(1, t), (5, other), (7, rows[3][1]), (None, "no id and no copies")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_tree_keeps_what_links_connect():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 2**63, (2, 80), dtype=np.uint64)
    x[40:] = x[:40] ^ np.uint64(7)
    y[40:] = y[:40]
    assert sorted(tuple(sorted(e)) for e in near_copies.tree_within(x, y, 20)) == [(i, i + 40) for i in range(40)]


def printed(n, count, width, seed):
    """Random fingerprints and, for each of the first half, one of the second that differs in one bit of every block and in 20 of the others."""
    rng = np.random.default_rng(seed)
    words = -(-count * width // 64) + 2
    bits = rng.integers(0, 2, (2 * n, words * 64), dtype=np.uint8)
    bits[n:] = bits[:n]
    for i in range(n, 2 * n):
        bits[i, np.arange(count) * width + rng.integers(0, width, count)] ^= 1
        bits[i, words * 64 - 128 + rng.choice(128, 20, replace=False)] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def searched(spark, bits, shape):
    rows = [(i, b.tobytes(), b"") for i, b in enumerate(bits)]
    distinct = spark.createDataFrame(rows, "node bigint, bits binary, prefix binary").repartition(3)
    return {(r["a"], r["b"]) for r in near_copies.candidates(distinct, *shape).collect()}


@pytest.mark.parametrize("part", [16000, 30])
def test_trees_find_what_no_equal_block_shows(spark, monkeypatch, part):
    """Every pair within the radius in a block is found, though no block is equal; of others only such as are near on the further bits."""
    width, count, radius = near_copies.forest_for(256_000)
    assert (width, count, radius) == (12, 12, 1)
    monkeypatch.setattr(near_copies, "LEAF", 60)
    monkeypatch.setattr(near_copies, "LEAF_PART", part)
    bits = printed(400, count, width, 5)
    forest = near_copies.Forest(bits, len(bits), width, count, radius)
    assert all(len(t.shares) > 4 for t in forest.trees)
    own = near_copies.blocks_of(bits, width, count)
    assert not (own[:400] == own[400:]).any()
    found = searched(spark, bits, (width, count, radius))
    assert {(i, i + 400) for i in range(400)} <= found
    assert all(np.bitwise_count(bits[a, -2:] ^ bits[b, -2:]).sum() <= near_copies.RADIUS for a, b in found)


def test_trees_at_radius_0_find_equal_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MANY", 1)
    monkeypatch.setattr(near_copies, "LEAF", 60)
    width, count, radius = near_copies.forest_for(800)
    assert radius == 0
    bits = printed(400, count, width, 8)
    for i in range(400):  # an equal block for each pair
        one = np.unpackbits(bits[[i, 400 + i]].view(np.uint8), axis=1, bitorder="little")
        at = slice(i % count * width, (i % count + 1) * width)
        one[1, at] = one[0, at]
        bits[400 + i] = np.packbits(one[1], bitorder="little").view(np.uint64)
    assert {(i, i + 400) for i in range(400)} <= searched(spark, bits, (width, count, radius))


def test_components_and_pairs_of_a_leaf():
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    group = rng.integers(0, 40, 300)
    x, y = x[group] ^ (np.uint64(1) << rng.integers(0, 60, 300, dtype=np.uint64)), y[group]
    found = near_copies.components(np.zeros(300, np.uint32), x, y, 300, 1)
    assert sorted(sorted(c.tolist()) for c in found) == sorted(np.flatnonzero(group == g).tolist() for g in range(40) if (group == g).sum() > 1)
    big = np.zeros(50, np.uint64)
    pairs, every = near_copies.pairs_of(big, np.arange(50, dtype=np.uint64))
    assert not every and len({i for p in pairs.tolist() for i in p}) == 50 and len(pairs) <= near_copies.DENSE * 50
    pairs, every = near_copies.pairs_of(big[:10], big[:10])
    assert every and len(pairs) == 45


def test_what_a_fingerprint_sends_and_a_dense_group_proposes():
    """Leaves get few bytes for each fingerprint, and rows in proportion to a dense group's size, which still stays in one piece."""
    width, count, radius = near_copies.forest_for(240_000)
    rng = np.random.default_rng(9)
    random_ones = rng.integers(0, 2**63, (4000, -(-count * width // 64) + 2), dtype=np.uint64) * np.uint64(2)
    forest = near_copies.Forest(random_ones, 240_000, width, count, radius)
    node = np.arange(len(random_ones), dtype=np.int64)
    assert forest.dealt_out(node, random_ones)[0].nbytes < 2000 * len(node)

    r = random.Random(3)
    base = [r.randrange(10**9) for _ in range(200)]
    edited = [" ".join(str(r.randrange(10**9) if r.random() < 0.02 else w) for w in base) for _ in range(1200)]
    bits = np.concatenate([np.stack([near_copies.signature(near_copies.shingle_set(t), random_ones.shape[1]) for t in edited]), random_ones])
    node = np.arange(len(bits), dtype=np.int64)
    rec, leaf = near_copies.Forest(bits, 45_000, width, count, radius).dealt_out(node, bits)
    found = [near_copies.proposed(rec[leaf == at], radius, int(at)) for at in np.unique(leaf)]
    pairs = np.concatenate(found)
    assert (pairs < 1200).all() and len(pairs) < 60 * 1200
    label = near_copies.joined(np.arange(1200), *np.unique(pairs, axis=0).T)
    assert len(np.unique(label)) == 1


def test_bitmaps_keep_every_pair_that_can_be_similar(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 600), dtype=np.uint64))
        own = rng.random(len(x)) < rng.choice([0.5, 0.85, 0.9, 1])
        y = np.unique(np.r_[x[own], rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64)])
        at_most = near_copies.shared_at_most(near_copies.bitmap(x), len(x), near_copies.bitmap(y), len(y))
        assert own.sum() <= at_most <= min(len(x), len(y))
        rows.append((i, x, y, own.sum() / (len(x) + len(y) - own.sum())))
    sets = [(2 * i + j, len(s), near_copies.bitmap(s)) for i, x, y, _ in rows for j, s in enumerate((x, y))]
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i, *_ in rows], "a bigint, b bigint")
    left = {r["a"] // 2 for r in near_copies.possible(pairs, spark.createDataFrame(sets, "node bigint, n bigint, map binary")).collect()}
    similar = {i for i, *_, s in rows if s >= 0.8}
    assert similar <= left and 50 < len(similar) and len(left) < len(similar) + 60


def family(r, n, size, most):
    """Edits of a text of words, each with up to `most` words replaced."""
    base = [r.randrange(10**9) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(size), r.randint(1, most)):
            w[at] = r.randrange(10**9)
        out.append(" ".join(map(str, w)))
    return out


def first_of_class(sets):
    """For each set the first of its class: components of all pairs of similarity 0.8."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a) * 0.8 <= len(b) <= len(a) / 0.8 and similarity(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 9000])
def test_dense_groups_lose_no_link(spark, monkeypatch, block):
    """Families whose members are all near each other in bits, some of them in words: exact classes, in one block or several, and few rows proposed."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(21)
    texts = family(r, 300, 120, 7) + family(r, 200, 220, 11) + family(r, 150, 40, 3) + family(r, 30, 400, 30)
    want = first_of_class([shingles(t) for t in texts])
    assert 100 < len(set(want)) < len(texts) - 100
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in near_copies.classes(df).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("n, size, most", [(250, 100, 14), (300, 20, 3), (150, 6, 1), (120, 150, 60)])
def test_classes_of_sets(n, size, most):
    """Against all pairs; with two sides, what both and their pairs give together is the same."""
    rng = np.random.default_rng(n + size)
    base, sets = rng.integers(0, 2**62, size), [np.array([], np.int64)]
    for _ in range(n):
        x = base.copy()
        at = rng.choice(size, rng.integers(0, most + 1), replace=False)
        x[at] = rng.integers(0, 40 * size, len(at))
        sets.append(np.unique(x[: rng.integers(size - size // 10, size + 1)]))
    sets = [np.array(s, np.int64) for s in sorted({tuple(s.tolist()) for s in sets})]
    of = lambda rows, side: near_copies.classes_of(np.concatenate([sets[i] for i in rows]), np.r_[0, np.cumsum([len(sets[i]) for i in rows])], side)
    every = np.arange(len(sets))
    want = first_of_class([set(s.tolist()) for s in sets])
    assert of(every, np.zeros(len(sets), bool)).tolist() == want
    side = every % 3 == 0
    label = near_copies.joined(every, every, of(every, side))
    for rows in (every[side], every[~side]):
        label = near_copies.joined(label, rows, rows[of(rows, np.zeros(len(rows), bool))])
    assert label.tolist() == want


def test_classes_of_sets_with_nothing_in_common():
    of = lambda *sets: near_copies.classes_of(np.array([h for s in sets for h in s], np.int64), np.r_[0, np.cumsum([len(s) for s in sets])], np.zeros(len(sets), bool)).tolist()
    assert of([1, 2, 3], [4, 5], [6]) == [0, 1, 2] and of([]) == [0] and of([1], []) == [0, 1]


def test_a_group_of_any_size_is_named_by_a_row_each():
    rng = np.random.default_rng(6)
    words = [np.zeros(500, np.uint64), rng.integers(0, 8, 500).astype(np.uint64)]
    words[0][300:] = np.uint64(2**64 - 1)
    node = rng.permutation(500).astype(np.int64)
    rows = near_copies.named(node, np.arange(500), *near_copies.pairs_of(*words))
    first, second = node[:300], node[300:]
    assert len(rows) == 498 and {tuple(x) for x in rows.tolist()} == {(x, min(g)) for g in (first.tolist(), second.tolist()) for x in g if x > min(g)}
