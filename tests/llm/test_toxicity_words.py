"""Scores use the ratio of every labelled word, however few words are sent to tasks."""

import random

import pytest

from swellframe.llm import toxicity


def test_rare_words_count_at_every_bound(spark, monkeypatch):
    r = random.Random(8)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rare = ["".join(r.choice("uvwxyz") for _ in range(6)) for _ in range(50)]
    docs, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        docs.append((i, " ".join([r.choice(common) for _ in range(40)] + ([r.choice(rare)] * 2 if toxic else []))))
        labels.append((i, 0, toxic))
    docs += [(None, " ".join(rare[:3])), (900, None), (901, "new words only here"), (901, common[0])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    whole = sorted((x["doc_id"] or -1, x["score"]) for x in toxicity.scores(d, lab).collect())
    monkeypatch.setattr(toxicity, "MODEL_ENTRIES", 20)
    bounded = sorted((x["doc_id"] or -1, x["score"]) for x in toxicity.scores(d, lab).collect())
    assert [i for i, _ in whole] == [i for i, _ in bounded] and len(whole) == len(docs)
    assert [s for _, s in bounded] == pytest.approx([s for _, s in whole], abs=1e-6)
    assert max(s for _, s in whole) > 0.5


def test_pairs_and_neighbours_against_brute_force(spark):
    """Exact counts of left neighbours (far over the old 266) and of pairs, hot words dealt by pair."""
    import collections

    import numpy as np
    import xxhash

    r = random.Random(2)
    letters = "abcdefghijklmnop"
    vocabulary = ["".join(r.choice(letters) for _ in range(5)) for _ in range(700)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(40):
            w += [r.choice(vocabulary), "hub"]
        rows.append((" ".join(w), i % 3 == 0))
    rows += [("", True), (None, False)]
    df = spark.createDataFrame([(t, int(y)) for t, y in rows], "text string, label int").repartition(5)
    key = lambda x: np.uint64(xxhash.xxh3_64_intdigest(x.encode()))
    got = toxicity.pair_counts(df, np.array([key("hub")], np.uint64)).collect()
    left, pairs = collections.defaultdict(set), collections.defaultdict(lambda: [0, 0])
    for t, y in rows:
        w = (t or "").split()
        for a, b in zip([None, *w], w):
            left[b].add(a)
            if a is not None:
                pairs[a, b][0 if y else 1] += 1
    signed = lambda x: int(x.view(np.int64))
    mine = collections.Counter()
    for x in got:
        if x["v"] is None:
            mine[x["w"]] += x["neighbours"]
    assert mine == {signed(key(w)): len(v) for w, v in left.items()} and len(left["hub"]) > 500
    assert {(x["v"], x["w"]): (x["toxic"], x["ordinary"]) for x in got if x["v"] is not None} == {(signed(key(a)), signed(key(b))): tuple(n) for (a, b), n in pairs.items() if max(n) > 1}


def test_expressions_of_ordinary_words(spark):
    """A pair of ordinary words that only toxic texts have in that order is told by the pair."""
    r = random.Random(12)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    docs, labels = [], []
    for i in range(800):
        toxic = int(i % 4 == 0)
        w = [r.choice(common) for _ in range(40)]
        for at in r.sample(range(0, 38, 4), 4):
            w[at : at + 2] = ["go", "away"] if toxic else ["away", "go"]
        docs.append((i, " ".join(w)))
        labels.append((i, 0, toxic))
    got = toxicity.scores(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).where("held_out").collect()
    assert len(got) > 100 and sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in got) > 0.97 * len(got)


def test_only_toxic_rows_of_an_id_go(spark):
    r = random.Random(4)
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    docs = [(i, " ".join([r.choice(common) for _ in range(30)] + (["vile"] * 3 if i % 4 == 0 else [])), "x", 1) for i in range(400)]
    odd = [(2, "vile vile " * 20, "y", 2), (None, "vile vile " * 20, "y", 3), (None, docs[1][1], "y", 4)]
    lab = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, of_text string, row int")
    kept = toxicity.not_toxic(df, lab)
    assert kept.columns == df.columns
    got = kept.collect()
    assert {(x["doc_id"], x["row"]) for x in got} == {(i, 1) for i in range(400) if i % 4} | {(None, 4)}
    assert toxicity.not_toxic(df.limit(0), lab).count() == 0
