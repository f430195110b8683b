"""Operator 5 against a version of its model in plain Python; operator 6 on pages with media against another parser."""

import collections
import hashlib
import math
import xml.etree.ElementTree as Tree

import pytest
import xxhash
from pyspark.sql import functions as F

from swellframe.llm import common, media, url_filter

ORDER = 3


def verdicts_of(rows):
    """(page_id, rule, verdict, log_ratio) by counting in dictionaries and recursion over contexts. rows: page_id, host, path, rule, by_rule."""

    def grams(text):
        padded = url_filter.PAD * ORDER + text
        return [padded[i : i + ORDER + 1] for i in range(len(text))]

    def learned(verdict):
        n = collections.Counter()
        for _, host, path, _, by_rule in rows:
            h = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(host.encode(), 42))
            if by_rule == verdict and (h - (h >> 63 << 64)) % url_filter.CALIBRATE_ONE_IN:
                for g in grams(host + path):
                    for k in range(ORDER + 1):
                        n[g[ORDER - k :]] += 1
        of = collections.defaultdict(lambda: [0, 0])
        for tail, c in n.items():
            of[tail[:-1]][0] += c
            of[tail[:-1]][1] += 1
        return n, of

    alphabet = len({c for _, host, path, _, _ in rows for c in host + path}) + 1
    models = [learned(v) for v in ("allow", "block")]

    def p(model, g):
        n, of = model
        out = 1 / alphabet
        for k in range(ORDER + 1):
            tail = g[ORDER - k :]
            total, kinds = of.get(tail[:-1], (0, 0))
            if total:
                out = (n[tail] + kinds * out) / (total + kinds)
        return out

    ratio = {}
    for _, host, path, _, _ in rows:
        own = grams(host + path)
        ratio[host, path] = sum(math.log(p(models[0], g) / p(models[1], g)) for g in own) / len(own) if own else 0.0

    def by_class(left_out):
        found = collections.defaultdict(list)
        for _, host, path, _, by_rule in rows:
            h = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(host.encode(), 42))
            if by_rule and (not left_out or (h - (h >> 63 << 64)) % url_filter.CALIBRATE_ONE_IN == 0):
                found[by_rule].append(ratio[host, path])
        return found

    found = by_class(True)
    found = found if len(found) == 2 else by_class(False)
    (a, sa), (b, sb) = ((m := sum(x) / len(x), math.sqrt(sum((y - m) ** 2 for y in x) / len(x)) + 1e-9) for x in (found["allow"], found["block"]))
    bound = (a * sb + b * sa) / (sa + sb)
    return {(i, host, path, rule, by_rule or ("allow" if ratio[host, path] >= bound else "block"), None if rule else round(ratio[host, path], 4)) for i, host, path, rule, by_rule in rows}, bound, ratio


@pytest.mark.parametrize("bound", [None, 5])
def test_url_verdicts_against_plain_counting(spark, monkeypatch, bound):
    """Every given page; with a bound of five rows, by shuffles with common pairs apart."""
    if bound:
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "no scheme"), (-4, "http://"), (-5, "http://é.org/ü" + "x" * 5000), (-5, "http://again.net/fr/")], "page_id bigint, url string"))
    host, path = url_filter.host_and_path(F.col("url"))
    fit = url_filter.rule_of(host, path)
    rows = [tuple(r) for r in pages.select("page_id", host, path, fit.rule, fit.verdict).collect()]
    want, limit, ratio = verdicts_of(rows)
    assert min(abs(x - limit) for x in ratio.values()) > 1e-9  # no verdict hangs on rounding
    got = [tuple(r) for r in url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("log_ratio", 4)).collect()]
    close = lambda r: (*r[:5], None if r[5] is None else round(r[5], 3))
    assert len(got) == len(rows) and collections.Counter(map(close, got)) == collections.Counter(close(w) for r in rows for w in want if w[:4] == r[:4])
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_urls_send_no_hosts_or_paths_to_their_pairs(spark, monkeypatch):
    """Beyond the bound, what is shuffled to meet the ratios is a row's number and a pair."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = common.stored(spark.createDataFrame([(i, "h.org", f"/{i}") for i in range(50)], "row bigint, host string, path string"), "t")
    ratios = common.stored(rows.select(F.explode(url_filter.pairs(F.concat("host", "path"), ORDER)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.lit(0.5).alias("ratio")), "t")
    plan = url_filter.mean_ratios(rows, ratios, ORDER)._jdf.queryExecution().optimizedPlan()

    def joins(node):
        found = [node] if node.nodeName() == "Join" else []
        for i in range(node.children().size()):
            found += joins(node.children().apply(i))
        return found

    sides = [str(j.children().apply(0).output()) for j in joins(plan)]
    assert sides and not [s for s in sides if "host" in s or "path" in s]


def test_real_markup():
    of = lambda html: [(p["kind"], p["text"] or p["ref"], p["caption"]) for p in media.sequence(html)]
    assert of("<p>one</p><figcaption>loose <b>words</b></figcaption>x") == [("text", "one", None), ("text", "loose words", None), ("text", "x", None)]
    nested = "<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><img src=c><figcaption>outer</figcaption></figure><img src=d alt=D>"
    assert of(nested) == [("media", "a", "outer"), ("media", "b", "inner"), ("media", "c", "outer"), ("media", "d", "D")]
    before = "<figure><figcaption>outer</figcaption><figure><img src=b alt=x><figcaption>inner</figcaption></figure><figure><img src=c alt=y></figure></figure>"
    assert of(before) == [("media", "b", "inner"), ("media", "c", "outer")]
    assert of("a<noscript><img src=x>no</noscript>b<template><img src=y></template>c</template>") == [("text", "abc", None)]
    assert of("a<noscript>kept<p>rest<template>gone</template> <img src=z>end") == [("text", "akept", None), ("text", "rest", None), ("media", "z", None), ("text", "end", None)]
    assert of('<script>"<img src=no>"</script>t<script>never ends') == [("text", "t", None)]
    assert of('<img src="data:x,y" data-src=late><img src="data:x,y"><img srcset="s 100w, l 200w"><video poster=p src=v></video><object data=o>else</object>') == [
        ("media", "late", None), ("media", "data:x,y", None), ("media", "l", None), ("media", "v", None), ("media", "p", None), ("media", "o", None), ("text", "else", None),
    ]
    assert of("<figure><img src=a><figcaption>never ends") == [("media", "a", "never ends")] and of("") == of(None) == of("<img>") == []
    found = {s: media.largest_candidate(s) for s in ("a 1x, b 2x", "a", "  a.png 2x", "u?w=1,2 300w, v 20w", "a 1x, b 1x", "", " , ", "a 1.2.3w, b")}
    assert list(found.values()) == ["b", "a", "a.png", "u?w=1,2", "a", None, None, "b"]
    many = media.sequence("<figure>" * 5000 + "<img src=a><figcaption>x</figcaption>" * 5000)
    assert len(many) == 5000 and many[0]["caption"] == " ".join(["x"] * 5000)


def parsed(page):
    """The sequence of a well-formed page, by a tree: (kind, text or reference, caption)."""
    out, pending = [], []

    def flush():
        if own := " ".join("".join(pending).split()):
            out.append(("text", own, None))
        pending.clear()

    def caption_of(figures):
        for f in reversed(figures):
            for c in f:
                if c.tag == "figcaption":
                    return " ".join("".join(c.itertext()).split())

    def walk(node, figures):
        block = node.tag in media.BLOCK_TAGS or node.tag in media.MEDIA_TAGS
        if block:
            flush()
        figures = [*figures, node] if node.tag == "figure" else figures
        if node.tag in ("noscript", "template") or (node.tag == "figcaption" and figures):
            pass
        else:
            caption = caption_of(figures)
            for attribute in {"img": ("src",), "video": ("src", "poster"), "object": ("data",)}.get(node.tag, ()):
                if node.get(attribute):
                    out.append(("media", node.get(attribute), caption if caption is not None else node.get("alt")))
            pending.append(node.text or "")
            for child in node:
                walk(child, figures)
                pending.append(child.tail or "")
        if node.tag in media.BLOCK_TAGS:
            flush()

    walk(Tree.fromstring(page), [])
    flush()
    return out


def test_pages_with_media_resolve_to_their_payloads(spark):
    """Pages written from the given documents: order, captions and payloads of nested figures, posters, objects and loose media."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    made = docs.select("doc_id", "text", media.payload_of(F.col("text")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    table = media.read_back(media.stored_payloads(made))
    words = F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z ]", " ")
    form = (
        '<article><h1>%1$s</h1><p>before %2$s <img src="sha256:%3$s" alt="own"/> after</p><figure><img src="sha256:%3$s" alt="no"/><figure><video src="sha256:%3$s" poster="p%1$s"/>'
        '<figcaption>inner <b>%2$s</b></figcaption></figure><object data="SHA256:%3$s">else</object><figcaption>outer %1$s</figcaption></figure><noscript><img src="x"/>no</noscript>'
        '<figcaption>loose %1$s</figcaption><figure><figure><img src="sha256:none%1$s"/></figure><figcaption>far</figcaption></figure>end</article>'
    )
    pages = made.select("doc_id", F.format_string(form, F.col("doc_id").cast("string"), words, "digest").alias("html"))
    out = media.resolved(media.interleaved(pages), table).collect()
    payloads = {r["doc_id"]: bytes(r["payload"]) for r in made.collect()}
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["position"])):
        assert r["position"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append((r["kind"], r["text"] if r["kind"] == "text" else r["ref"], r["caption"]))
        own = (r["ref"] or "").lower() == "sha256:" + hashlib.sha256(payloads[r["doc_id"]]).hexdigest()
        assert (r["payload_bytes"], r["payload_sha256"]) == ((len(payloads[r["doc_id"]]), (r["ref"] or "")[7:].lower()) if own else (None, None))
    every = pages.collect()
    assert len(every) == len(got) and all(parsed(r["html"]) == got[r["doc_id"]] for r in every)
    assert sum(k == "media" for k, _, _ in got[every[0]["doc_id"]]) == 6
