"""Every registered query on empty tables, and on rows with nulls, repeats, very long texts and columns whose names are used inside."""

import pytest

from swellframe.llm import queries

CLASH = ["gone_id", "gone_text", "host", "score", "salt", "q", "v", "z", "row", "k", "first", "of_text", "w", "h", "b", "to", "x0", "node", "item", "part", "word", "words", "label", "fit", "digest", "payload", "n", "sh", "length", "piece", "at", "gram", "hash", "fp", "least", "key", "total"]
LONG = "a fairly long text of a few words that goes on and on without an end, "


def tables(spark, folder, empty):
    """The tables that the queries read, with few and odd rows."""
    extra = ", ".join(f"{c} int" for c in CLASH)
    more = tuple(range(len(CLASH)))
    texts = [None, "", "  \n\t", "word", LONG * 30_000, LONG * 40, "ünïcödé £ 日本語 \U0001d518 " * 200, "x" * 300_000, LONG * 40]
    docs = [(i, t, None if i % 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None), (5, "other text of the same id", None, None, None), (None, LONG * 40, None, None, None), (None, None, None, None, None)]
    labels = [(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (3, 1, 1)]
    pages = [(i, u, t) for i, (u, t) in enumerate(zip(["http://a.com/x", None, "", "no scheme", "http://b.net/es/" + "y" * 20_000, "http://b.net/fr/", "http://www.example.com/en/q", "ftp://c.org?x"], ["<p>" + LONG * 2000, None, "", "<figure><img src='a'>", "<p>same" * 50, "<p>same" * 50, "<!--", LONG * 9]))]
    pages += [(1, None, None), (None, "http://a.com/", "<p>same" * 50)]
    bench = [(1, LONG), (2, None), (3, ""), (4, "two words"), (None, LONG * 3), (1, "another item of the same id")]
    vectors = [(0, [0.5] * 16, 1), (1, None, 1), (2, [], 1), (3, [None] * 16, 1), (4, [float("nan")] * 16, None), (5, [0.25] * 16, None), (5, [0.25] * 16, 2), (None, [1.0] * 16, 2)]
    df = spark.createDataFrame([r + more[1:] for r in vectors], "vec_id bigint, embedding array<float>, label int, " + ", ".join(f"{c} int" for c in CLASH if c != "label"))
    (df.limit(0) if empty else df).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    for name, schema, rows in (
        ("documents", "doc_id bigint, text string, lang string, source string, n_chars int", docs), ("labels", "doc_id bigint, quality int, toxic int", labels),
        ("pages", "page_id bigint, url string, html string", pages), ("benchmark", "item_id bigint, text string", bench),
    ):
        df = spark.createDataFrame([r + more for r in rows], f"{schema}, {extra}")
        (df.limit(0) if empty else df).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return {"documents": len(docs), "pages": len(pages)}


@pytest.mark.parametrize("empty", [True, False])
def test_every_query(spark, tmp_path, empty):
    size = tables(spark, str(tmp_path), empty)
    for name, query in queries.queries().items():
        n = query(spark, str(tmp_path)).count()
        if empty:
            assert n == 0, name
        elif name in ("op1_warc", "op5_url_filter"):
            assert n == size["pages"], name
        elif name in ("op2_simhash", "op3_substring_dedup", "op4_suffix_array_dedup", "op6_media_columns", "op8_toxicity", "op13_host_rules"):
            assert n == size["documents"], name
        elif name == "op9_best_fit_packing":
            assert n >= size["documents"], name
        elif name == "op11_vector_codes":
            assert n == 4
