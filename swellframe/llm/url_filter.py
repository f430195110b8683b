"""URL filters: rules first, then a character language-model ratio; DataFrame expressions only.

Rules have a host and a path prefix and fit that host, its subdomains and paths that start so; the longest wins. URLs that
an allow rule fits are the accepted ones, those of block rules the rejected ones. Two variable-order Markov models over characters of host
and path (contexts of up to `order` characters) are learned from them, with Witten-Bell smoothing: a context's estimate is mixed
with that of the context one character shorter, in the proportion of its count to its distinct successors, down to a uniform
choice. A URL that no rule decides is judged by the mean difference of log-likelihoods per character.

One in CALIBRATE_ONE_IN of the URLs that a rule decides (by a hash of host and path) is left out of the counts. The threshold is calibrated on
these: where the two classes, with their means and deviations, err equally often. If they lack a class, all that rules decide are used.

All counts come from grouped sums over (context, character) pairs, which a table of pairs bounds: there are far fewer than URLs, and a
very common host adds to few of them, summed before the shuffle. The pair table is broadcast only under a
counted bound; beyond it a URL sends the number of its row and its pairs, never host or path, and common pairs meet their ratios without
a shuffle. Sums by row, made before they are sent, meet hosts and paths once.

Defined results: null urls and those without :// have empty host and path, and as an empty text a log-ratio of 0; rows that repeat a page_id are
judged apart; an empty table gives an empty result; if either class has no URL, what no rule decides is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_group
from .decontam import LOWER, UPPER

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Of the URLs that rules decide, those that calibrate.
CALIBRATE_ONE_IN = 5
#: Stands before the first character of a URL, as often as the order asks.
PAD = "\u0001"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def pairs(text: Column, order: int) -> Column:
    """An array of every character with its context: order + 1 characters each."""
    padded = F.concat(F.lit(PAD * order), text)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(order + 1)))).otherwise(F.array().cast("array<string>"))


def log_ratios(judged: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """gram, ratio: log p(accepted) - log p(rejected) of the last character of each wanted gram after the others.

    judged: gram, good, bad (counts). wanted: gram.
    """
    alphabet = wanted.select(F.substring("gram", order + 1, 1).alias("c")).distinct().count() + 1
    out = wanted.withColumns({"p_good": F.lit(1.0 / alphabet), "p_bad": F.lit(1.0 / alphabet)})
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        n = judged.groupBy(tail.alias("tail")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("context", F.substring("tail", 1, k))
        of = n.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count_if(F.col("good") > 0).alias("kinds_good"), F.count_if(F.col("bad") > 0).alias("kinds_bad"))
        out = out.withColumns({"tail": tail, "context": F.substring("gram", order + 1 - k, k)})
        out = out.join(n.select("tail", "good", "bad"), "tail", "left").join(of, "context", "left").na.fill(0, ["good", "bad", "all_good", "all_bad", "kinds_good", "kinds_bad"])
        for c in ("good", "bad"):
            seen = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            out = out.withColumn(f"p_{c}", F.when(seen > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / seen).otherwise(F.col(f"p_{c}")))
        out = out.select("gram", "p_good", "p_bad")
    return out.select("gram", F.log(F.col("p_good") / F.col("p_bad")).alias("ratio"))


def mean_ratios(rows: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """row, log_ratio: the mean ratio of a row's characters; none for empty URLs. ratios: gram, n (how often it is asked for), ratio."""
    asked = rows.select("row", F.explode(pairs(F.concat("host", "path"), order)).alias("gram"))
    met = with_group(asked, ratios, "gram", "n", ["ratio"])
    return met.groupBy("row").agg(F.avg("ratio").alias("log_ratio"))


def judge(pages: DataFrame, rules=RULES, order: int = 3, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, log_ratio (null where a rule decides), a row per input row."""
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict")
    p = p.withColumns({"fit": F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATE_ONE_IN)) > 0, "row": F.monotonically_increasing_id()})
    rows = stored(p, "urls")
    counts = lambda verdict: F.when(F.col("fit") & (F.col("verdict") == verdict), 1).otherwise(0)
    grams = rows.select(counts("allow").alias("g"), counts("block").alias("b"), F.explode(pairs(F.concat("host", "path"), order)).alias("gram"))
    counted = stored(grams.groupBy("gram").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"), F.count("*").alias("n")), "grams")
    ratios = log_ratios(counted.where("good > 0 or bad > 0"), counted.select("gram"), order)
    ratios = stored(ratios.join(counted.select("gram", "n"), "gram"), "ratios")
    scored = stored(rows.join(mean_ratios(rows, ratios, order), "row", "left").withColumn("log_ratio", F.coalesce("log_ratio", F.lit(0.0))).drop("row"), "scored")

    by_class = lambda rows: {r["verdict"]: r for r in rows.where("verdict is not null").groupBy("verdict").agg(F.avg("log_ratio").alias("m"), F.stddev_pop("log_ratio").alias("s")).collect()}
    stats = by_class(scored.where("not fit"))
    stats = stats if len(stats) == 2 else by_class(scored)
    bound = None
    if len(stats) == 2:
        (a, sa), (b, sb) = ((stats[v]["m"], stats[v]["s"] + 1e-9) for v in ("allow", "block"))
        bound = (a * sb + b * sa) / (sa + sb)
    by_model = F.lit("allow") if bound is None else F.when(F.col("log_ratio") >= bound, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.round("log_ratio", 6)).alias("log_ratio"))
