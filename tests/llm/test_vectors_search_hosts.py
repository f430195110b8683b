"""Operators 11 to 13 against brute force: vector codes, ranked search, host rules."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from swellframe.llm import host_rules, lexical, vector_codes
from swellframe.llm.common import with_group

# --- vector codes -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "width", "high"), [(1, 3, 5), (16, 8, 9), (64, 4, 3), (16, 8, 4000), (9, 0, 3)])
def test_nearest_by_masks_is_the_nearest(n, width, high):
    rng = np.random.default_rng(n + width)
    book = vector_codes.Codebook(rng.integers(-high, high, (n, width)))
    x = rng.integers(-2 * high, 2 * high, (3000, width))
    d = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    best, square = book.nearest(x)
    assert (best == d.argmin(axis=1)).all() and (square == d.min(axis=1)).all()  # argmin: the lowest on a tie


def test_masks_leave_few_candidates():
    rng = np.random.default_rng(3)
    book = vector_codes.Codebook(rng.integers(-4000, 4000, (64, 4)))
    x = book.entries[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4))
    _, square = book.nearest(x)
    found = np.bitwise_count(book.candidates(x, square))
    assert found.min() >= 1 and found.mean() < 1.5


def codes_by_brute_force(rows, parts, entries, rounds, scale=4096):
    """rows: (vec_id, vector, label) that are usable. -> Counter of result rows without label_error, codebooks."""
    ints = sorted(((i, [math.floor(scale * c) for c in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0))
    cuts = vector_codes.bounds(len(ints[0][1]), parts)
    books = [[v[a:b] for _, v, _ in ints[:entries]] for a, b in cuts]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    nearest = lambda x, book: min((square(x, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for (a, b), book in zip(cuts, books, strict=True):
            own = collections.defaultdict(list)
            for _, v, _ in ints:
                own[nearest(v[a:b], book)[1]].append(v[a:b])
            for j, xs in own.items():
                book[j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in ints:
        found = [nearest(v[a:b], book) for (a, b), book in zip(cuts, books, strict=True)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


VECTORS = "vec_id bigint, embedding array<float>, label int, n int, v int, q int, top int"


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, 10)], [0, 1, None][i % 3]) for i in range(120)]
    good += [(None, good[3][1], 1), (7, good[7][1], 1)] + [(200 + i, good[0][1], 0) for i in range(60)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 10, 1), (903, [1.0] * 9 + [float("inf")], 1), (904, [1.0] * 9 + [None], 1), (905, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in good + bad], VECTORS).repartition(4)
    want, books = codes_by_brute_force(good, 4, 8, 3)
    got = [tuple(r) for r in vector_codes.digests(df, parts=4, entries=8, rounds=3).collect()]
    labels = collections.Counter()
    for _, label, _, e in want:
        labels[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert collections.Counter(got) == collections.Counter((i, code, e, labels[label], sha) for i, label, code, e in want)


def test_codes_beyond_64_bit_products(spark):
    rows = [(i, [2.0**45 * (-1) ** i + i, float(i)], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_codes.digests(df, parts=1, entries=3, rounds=1).collect()}
    for i, _, code, e in codes_by_brute_force(rows, 1, 3, 1)[0]:
        assert (got[i]["code"], got[i]["error"]) == (code, e if e < 2**63 else None)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.digests(df).collect() == [] and vector_codes.digests(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    one = vector_codes.digests(spark.createDataFrame([(1, [0.5] * 8, None)], "vec_id bigint, embedding array<float>, label int")).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00" * 8, 0, 0)


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_groups_come_back_to_their_rows(spark, monkeypatch, bound):
    """By broadcast, and with common keys apart; nulls are a key."""
    monkeypatch.setattr("swellframe.llm.common.BROADCAST_ROWS", bound)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}", 0) for i in range(3000)], "i int, key string, m int")
    groups = rows.groupBy("key").count().selectExpr("key", "count", "count * 2 as twice")
    got = with_group(rows, groups, "key", "count", ["twice"])
    assert got.columns == ["i", "key", "m", "twice"] and got.count() == 3000
    assert {(r["key"], r["twice"]) for r in got.where("key = 'hot' or key is null").select("key", "twice").distinct().collect()} == {("hot", 3000), (None, 600)}
    assert got.where("key like 'k%' and twice = 2").count() == 1200


# --- ranked search ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranks_by_brute_force(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text). -> Counter of (item_id, rank, doc_id, score)."""
    own = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    total, words = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i, c, n in own:
            if n:
                m = 100 - 75 + (75 * n * total) // words
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out.update((item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k]))
    return out


DOCS = [
    (1, "The cat, the CAT; a cat's hat"), (2, "cat\x00hat\x7fcat"), (3, "concatenate the cats"), (4, None), (5, ""), (6, " \n\t.,;"), (7, "ÉCOLE école Ünï日本 cat"), (8, "hat " * 5000 + "cat"),
    (8, "another cat of the same id"), (None, "the hat the hat"), (None, None), (9, "x" * 70_000 + " cat " + "y" * 70_000), (10, "the"), (11, "The cat, the CAT; a cat's hat"),
]
ITEMS = [(1, "cat"), (2, "the cat the cat hat"), (3, None), (4, ""), (5, "école日本 Ünï日本"), (6, "missing words"), (1, "hat"), (None, "a's"), (7, "The THE the")]


@pytest.mark.parametrize("piece", [1 << 19, 64])
def test_ranks_match_brute_force(spark, monkeypatch, piece):
    """Guards, other alphabets, ties, repeats; also pieces far shorter than texts."""
    monkeypatch.setattr(lexical, "PIECE", piece)
    r = random.Random(2)
    docs = DOCS + [(100 + i, " ".join(r.choice(["cat", "hat", "the", "a", "of", "École", "7", "x1"]) for _ in range(r.randrange(1, 60)))) for i in range(200)]
    d = spark.createDataFrame([(*x, 0, "c") for x in docs], "doc_id bigint, text string, item int, score string").repartition(5)
    i = spark.createDataFrame([(*x, 0) for x in ITEMS], "item_id bigint, text string, salt int")
    got = collections.Counter(tuple(x) for x in lexical.ranked(d, i).collect())
    assert got == ranks_by_brute_force(docs, ITEMS)


def test_ranks_in_blocks_and_of_nothing(spark, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    i = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = ranks_by_brute_force(DOCS, ITEMS, 3)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(lexical, "SCORES", 5)  # two documents at once
    assert collections.Counter(tuple(x) for x in lexical.ranked(d, i, 3).collect()) == want
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id = 4"), i)):
        got = lexical.ranked(docs, items)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


# --- host rules -------------------------------------------------------------------------------------------------


def counts_by_brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("places", [host_rules.PLACES, 7])
def test_counts_match_brute_force(spark, monkeypatch, places):
    """By hashes, and by words where texts have more windows than there are places."""
    monkeypatch.setattr(host_rules, "PLACES", places)
    r = random.Random(4)
    texts = [None, "", " \n\t\r", "word", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a", "line\nline\n line\nline\r\nline\n\n \n", "é\U0001d518 £#|<> ** &%$", "x y z\x0bw\x1cv", "same words here " * 3000]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 120))) + r.choice(["", "\n"]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, ws int, host int").repartition(3)
    got = {x["doc_id"]: x for x in host_rules.judged(df).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == counts_by_brute_force(t), t


def test_hosts_are_judged_by_shrunk_rates(spark):
    """A host with many bad documents is rejected with its good ones, one with a single bad document is not, nor documents without a host."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(f"good{h}", good) for h in range(30) for _ in range(50)] + [("bad", "short")] * 95 + [("bad", good)] * 5 + [("new", "short"), ("new", good), (None, good), (None, "short")]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = host_rules.judged(df).collect()
    kept = collections.Counter((rows[x["doc_id"]][0], x["base_failed"], x["kept"]) for x in got)
    assert kept["bad", False, False] == 5 and kept["bad", True, False] == 95
    assert kept["new", False, True] == 1 and kept["new", True, False] == 1 and kept[None, False, True] == 1 and kept[None, True, False] == 1
    assert sum(v for (h, _, k), v in kept.items() if (h or "").startswith("good") and k) == 1500
    rate = {x["host"]: x["host_rate"] for x in got}
    # by hand: the prior's mean is over all documents of hosts, its strength from the hosts' variance less that of sampling
    n = {h: sum(x[0] == h for x in rows) for h in rate if h}
    f = {h: sum(x == (h, "short") for x in rows) for h in n}
    mean = sum(f.values()) / sum(n.values())
    between = np.var([f[h] / n[h] for h in n]) - mean * (1 - mean) * np.mean([1 / x for x in n.values()])
    strength = min(1000.0, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0
    assert rate["new"] == pytest.approx((1 + mean * strength) / (2 + strength), abs=1e-6) and rate["bad"] == pytest.approx((95 + mean * strength) / (100 + strength), abs=1e-6)


def test_host_rules_are_native(spark):
    """No Python in the plans of the counts or the verdicts."""
    df = spark.createDataFrame([(1, "text " * 60, "s")], "doc_id bigint, text string, source string").select("*")
    plan = host_rules.counted(df)._jdf.queryExecution().executedPlan().toString() + host_rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert host_rules.judged(df.limit(0)).collect() == []


# --- decontamination beyond its bounds ------------------------------------------------------------------------------


def test_large_searches_shuffle_hashes_only(spark, monkeypatch):
    """Without broadcasts: the same rows, repeated and missing ids too, and neither texts nor words under an exchange."""
    from swellframe.llm import decontam

    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 9, 40])))) for i in range(12)] + [(None, "w1 w2 w3 w4 w5 w6"), (13, None), (14, "W1 w2")]
    docs = [(i % 50, " ".join(r.choice(words) for _ in range(30)) + " " + items[i % 12][1] + " and the end") for i in range(70)] + [(None, items[3][1]), (99, None), (98, "")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, row int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(decontam.contained_items(d, i))
    assert len(want) > 60
    monkeypatch.setattr(decontam, "small", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontam.contained_items(d, i)
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert rows(found) == want and decontam.contained_items(d, i.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
    assert len(moved) > 3 and not any(re.search(r"\b(ws|text|sh)#", x) for x in moved)
