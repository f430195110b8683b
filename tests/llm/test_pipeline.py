"""Every stage of the pipeline against brute force, each on what the one before kept of the smallest given tables."""

import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from swellframe.llm import toxicity
from swellframe.llm.common import rested

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_firsts(texts):
    """The smallest id of each class of texts whose shingle sets have similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if (a | b and len(a & b) >= 0.8 * len(a | b)) or not (a or b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def without_earlier_strings(texts, window=50):
    """Texts without the bytes of strings that a smaller id has; characters that are cut go wholly."""
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], i)
    for i, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        kept, p = [], 0
        for c in t or "":
            n = len(c.encode())
            if not any(gone[p : p + n]):
                kept.append(c)
            p += n
        out[i] = "".join(kept)
    return out


def contains_item(text, items):
    for u in items:
        n = min(5, len((u or "").split()))
        w = (text or "").lower().split()
        own = shingles(u, n) if n else set()
        have = {tuple(x.encode() for x in w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if own and len(own & have) >= 0.8 * len(own):
            return True
    return False


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    as_texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.scores(docs, labels).where("predicted = 1").collect()}

    out = stages["toxicity"](spark, docs, SF)
    texts = {i: t for i, t in as_texts(docs).items() if i not in bad}
    assert out.columns == columns and as_texts(out) == texts and len(texts) > 150

    out = stages["simhash near-dedup"](spark, out, SF)
    texts = {i: texts[i] for i in near_firsts(texts)}
    assert out.columns == columns and as_texts(out) == texts

    out = stages["suffix-array dedup"](spark, out, SF)
    texts = without_earlier_strings(texts)
    assert out.columns == columns and as_texts(out) == texts
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())

    out = stages["benchmark decontamination"](spark, out, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not contains_item(t, items)}
    assert out.columns == columns and as_texts(out) == texts

    got = stages["best-fit packing"](spark, out, SF).collect()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in texts.items():
        ids = tk.encode(t, add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096


def test_stages_of_empty_and_odd_tables(spark):
    """No rows; null texts and ids, repeated rows, columns with names that stages use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs.limit(0), docs.limit(3).unionByName(docs.limit(3)).selectExpr("case when doc_id = 1 then null else doc_id end doc_id", "case when doc_id = 2 then null else text end text", "lang", "source", "n_chars")):
        out = rows.selectExpr("*", "1 as row", "'x' as of_text", "2 as k", "3 as item")
        columns = out.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, SF)
            assert i == 4 or out.columns == columns
        assert out.count() >= 0


def test_executors_collect_between_stages(spark):
    collections_so_far = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = collections_so_far()
    rested(spark)
    assert collections_so_far() > before
