"""Operators 2, 3 and 4 against brute force on small texts with copies, repeats, nulls and ties."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from swellframe.llm import simhash, substring, suffix_array

SCHEMA = "doc_id bigint, text string, k string, b int"


def corpus(seed=1, n=60):
    """Rows (doc_id, text, k, b): random words, copies, edited copies, shared passages, repeats; k and b clash with inner names."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "   \t\n", "one", "x" * 300, "la la " * 80, "ab" * 200, passage]
    for i in range(n):
        kind = i % 6
        if kind == 0 and len(texts) > 10:
            texts.append(r.choice(texts))
        elif kind == 1:
            w = (r.choice(texts) or "a b").split()
            w[r.randrange(len(w)) if w else 0 : 1] = [word()]
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(" ".join(word() for _ in range(30)) + " " + passage + "\n" + " ".join(word() for _ in range(9)))
        else:
            texts.append(" ".join(word() for _ in range(r.randint(1, 150))))
    return [(i * 3, t, "clash", i) for i, t in enumerate(texts)]


def expected_windows(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    count = collections.Counter(b" ".join(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[b" ".join(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = [x for x, ok in zip(w, keep) if ok]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [22, 35])
def test_substring_windows(spark, window):
    rows = corpus()
    got = substring.digests(substring.remove_repeated_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), window)).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert got == {row[0]: e for row, e in zip(rows, expected_windows(rows, window))}


def expected_strings(rows, window):
    """By rows in the order given: equal strings of an earlier row with a smaller id."""
    first = {}
    for key, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], key)
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < key:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), sum(1 for s in bytes(gone).split(b"\0") if s), kept))
    return out


@pytest.mark.parametrize("many, size", [(4096, 1 << 20), (1, 1 << 10), (0, 1)])
def test_suffix_strings(spark, monkeypatch, many, size):
    """With the index, with small indexes, and with window hashes for every anchor."""
    monkeypatch.setattr(suffix_array, "MANY_SEGMENTS", many)
    monkeypatch.setattr(suffix_array, "INDEX_BYTES", size)
    rows = corpus(2)
    got = suffix_array.remove_repeated_strings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got}
    assert got == {row[0]: e for row, e in zip(rows, expected_strings([r[:2] for r in rows], 50))}


def test_index_samples():
    """The run-length index against a table of substrings, and its runs against the transform they stand for."""
    rng = np.random.default_rng(1)
    for depth in (5, 8, 17, 50):
        unit = rng.integers(97, 100, 70, dtype=np.uint8)
        text = np.concatenate([np.where(rng.random(70) < 0.03, 120, unit) for _ in range(20)]).astype(np.uint8)
        owner = np.sort(rng.integers(0, 9, len(text)))
        whole = np.arange(len(text)) + depth <= len(text)
        index = suffix_array.RunLengthIndex(text, depth, whole)
        least = {}
        for i in np.flatnonzero(whole):
            least.setdefault(text[i : i + depth].tobytes(), owner[i])
        got = index.smallest_owner(owner)
        assert all(got[i] == least[text[i : i + depth].tobytes()] for i in np.flatnonzero(whole))
        lengths = index.ends - index.starts + 1
        transform = np.repeat(index.heads, lengths)
        assert lengths.sum() == whole.sum() and (transform[1:] == text[index.order[1:] - 1])[index.order[1:] > 0].all()


@pytest.mark.parametrize("longest, part", [(1 << 26, 1 << 19), (1 << 9, 1 << 8)])
def test_suffix_strings_in_repetitive_and_long_texts(spark, monkeypatch, longest, part):
    """Units that a document repeats very often, cut and changed in others; texts beyond LONGEST come in overlapping parts."""
    monkeypatch.setattr(suffix_array, "LONGEST", longest)
    monkeypatch.setattr(suffix_array, "SLICE", part)
    r = random.Random(6)
    line = "".join(r.choice("abcdefgé ") for _ in range(70)) + "\n"
    unit = "xyz"
    texts = ["".join(r.choice("abc") for _ in range(900)), line * 300, line * 40 + "tail", unit * 1500, unit * 90, line[:60], "é" * 400]
    for _ in range(25):
        own = list(line * r.randint(1, 30))
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = r.choice("abcé")
        texts.append("".join(own))
        at = r.randrange(0, 700)
        texts.append(texts[0][at : at + r.randint(30, 200)] + unit * r.randint(1, 60))
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {row[0]: e for row, e in zip(rows, expected_strings([x[:2] for x in rows], 50))}
    got = suffix_array.remove_repeated_strings(df).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got} == want
    # as texts: characters that are cut go wholly
    kept = {x["doc_id"]: x["text"] for x in suffix_array.without_repeated_strings(df).collect()}
    for i, t, *_ in rows:
        left, whole, at = want[i][3], t.encode(), 0
        assert len(kept[i].encode()) <= len(left) and set(kept[i]) <= set(t)
        if left.isascii() and whole.isascii():
            assert kept[i].encode() == left


def test_repeated_and_null_ids(spark):
    """Rows that share an id have nothing of each other removed; rows without one come last."""
    t = "some text that is long enough to hold a window of fifty bytes or more " * 2
    rows = [(1, t, "a", 1), (1, t, "b", 2), (None, t, "c", 3), (2, None, None, None), (None, "only here " * 9, "d", 4), (None, "only here " * 9, "e", 5), (7, t, "f", 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = suffix_array.remove_repeated_strings(df, carried=("b",)).collect()
    assert {x["b"]: x["n_removed"] > 0 for x in got} == {1: False, 2: False, 3: True, None: False, 4: False, 5: False, 6: True}
    assert substring.remove_repeated_windows(df).count() == 7
    kept = suffix_array.without_repeated_strings(df)
    assert kept.columns == df.columns and kept.count() == 7
    assert simhash.classes(df).count() == 7


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring.remove_repeated_windows(df).count() == 0
    assert suffix_array.remove_repeated_strings(df).count() == 0
    assert simhash.classes(df).count() == 0


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_classes(spark):
    rows = corpus(3) + [(1000 + i, f"Same TEXT again and again with {w}", "", i) for i, w in enumerate(["end", "end", "End", "other"])]
    got = {r["doc_id"]: r for r in simhash.hexed(simhash.classes(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}
    prints = {i: brute_fingerprint(t or "") for i, t, *_ in rows}
    roots = components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_copies_of_a_fingerprint_stay_few():
    """Routing of random fingerprints, by how many there are in all: copies per row, and rows of a leaf part."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    sample, rows = draw(1 << 11), draw(1000)
    copies = {}
    for total in (10**7, 10**8, 10**10):
        plan = simhash.planned(sample, total, 4)
        rec, to = simhash.dealt_out(rows, plan)
        copies[total] = len(rec) / len(rows)
        assert (np.bincount(rec["home"], minlength=2)[1]) == len(rows) * len(plan[0])
    assert max(copies.values()) <= 36, copies


@pytest.mark.parametrize("many", [50_000_000, 10, 0])
def test_forest_loses_no_link(spark, monkeypatch, many):
    """Random fingerprints and a dense cluster, with tiny leaves and leaf parts, so that trees split, overlap and salt; by the masks for each size."""
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "LEAF", 40)
    monkeypatch.setattr(simhash, "LEAF_PART", 60)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(500)}
    centre = rng.getrandbits(64)
    for _ in range(300):
        x = centre
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    for x in list(prints)[:100]:
        prints.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint").repartition(3)
    from swellframe.llm.common import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df)).collect()}
    want = components({signed(x): x for x in prints})
    groups = collections.defaultdict(set)
    for x, r in want.items():
        groups[r].add(x)
    mine = collections.defaultdict(set)
    for x in want:
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    from swellframe.llm.common import connected_components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(-5, 7), (3, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in [7, -5, *range(200, 260)]} == {-5}
