"""Quality rules by host; DataFrame expressions only.

Each document has counts over its whole text: words, code points in words, symbols, repeated lines, and words in three-word windows that the text
has twice or more. The base rules decide a document by itself. The host rules decide documents by where they come from: failures of each rule are summed by
host, a host's rate is shrunk towards that of all hosts, and a host whose shrunk rate of some rule exceeds the rule's bound is rejected with
all its documents.

The prior is a beta distribution for each rule, fitted to the hosts by moments: its mean is the rate over all documents, its strength what is
left of the variance of the hosts' rates when the variance of sampling is taken out (between LEAST and MOST documents' worth). A host with few documents is judged by
the prior, one with many by its own rate.

Windows of a text are sorted within its row by numbers of hash and place. Where neighbours with equal hashes have equal words, these are the repeats; otherwise, or in texts
of more words than a place can hold, the words themselves are sorted. The distances of the sorted places give the words that repeats cover. A row's cost is n log n and
nothing of the text is shuffled. Counts are written once (five numbers a row); sums by host are pre-aggregated, and verdicts go back by
`with_group`, which splits common hosts.

Words are runs of other than space and bytes 9 to 13; lines end with \\n, and one with a word counts if it equals an earlier one. Defined results: a null text has no words and
fails the base rules; documents without a host are no host's, the base rules alone decide them; rows that repeat a doc_id are judged apart; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_group

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A document fails the base rules with fewer words than this, or with more than this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: Rules by host: what of a document fails (SQL over the counts), and the shrunk rate of failures above which a host is rejected.
HOST_RULES = {
    "base": ("base_failed", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "letters": ("word_chars < 3 * n_words or word_chars > 12 * n_words", 0.5),
}
#: Bits of a window's number that hold its place in the text, below those of its hash.
PLACES = (1 << 24) - 1
#: Bounds of the prior's strength.
LEAST, MOST = 2.0, 1000.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def repeated_by_words(z: str) -> Column:
    """Places of windows (an array of structs of words) that stand twice or more, by sorting the words themselves."""
    in_order = F.sort_array(F.transform(z, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    neighbours = lambda s: F.filter(s, lambda x, k: F.coalesce(x.w == F.get(s, k - 1).w, F.lit(False)) | F.coalesce(x.w == F.get(s, k + 1).w, F.lit(False)))
    # the array of one array binds the sorted windows to a name: they are sorted once
    return F.transform(F.element_at(F.transform(F.array(in_order), neighbours), 1), lambda x: x.i)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, a row per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    d = d.withColumn("ws", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    each = [F.slice("ws", k + 1, F.greatest(F.size("ws") - WINDOW + 1, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    d = d.select(
        "doc_id", "host", F.size("ws").alias("n_words"), F.length(F.array_join("ws", "")).alias("word_chars"), (F.size(F.split("text", f"[{SYMBOLS}]")) - 1).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.arrays_zip(*each).alias("z"),
    )
    # a projection for each array that is looked into: it is made once for a row
    place = lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int")
    d = d.withColumn("h", F.sort_array(F.transform("z", lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("bigint")))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), "h")
    d = d.withColumn("r", F.filter(F.arrays_zip(F.col("h").alias("b"), before.alias("a")), lambda x: x.a.bitwiseXOR(x.b).bitwiseAND(F.lit(~PLACES)) == 0)).drop("h")
    equal = F.forall("r", lambda x: F.get("z", place(x.a)) == F.get("z", place(x.b)))
    by_hash = F.array_distinct(F.concat(F.transform("r", lambda x: place(x.a)), F.transform("r", lambda x: place(x.b))))
    exact = F.when((F.size("z") <= PLACES) & equal, by_hash).otherwise(repeated_by_words("z"))
    d = d.withColumn("at", F.sort_array(exact)).drop("z", "r")
    covered = _total(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), x - F.get("at", k - 1))))  # the first has none before it, and least() skips nulls
    d = d.withColumn("n_repeat_words", covered).drop("at")
    numbers = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.select("doc_id", "host", *(F.col(c).cast("bigint").alias(c) for c in numbers), failed.alias("base_failed"))


def host_rates(documents: DataFrame, rules: dict = HOST_RULES) -> DataFrame:
    """host, n, and for each rule f_<rule> (documents that fail) and rate_<rule> (shrunk). documents: the rows of `counted`."""
    hosts = documents.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(fails)).alias(f"f_{r}") for r, (fails, _) in rules.items()))
    hosts = stored(hosts, "hosts")
    moments = [F.count("*").alias("hosts")]
    for r in rules:
        mean = F.sum(f"f_{r}") / F.sum("n")
        moments += [mean.alias(f"mean_{r}"), F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"var_{r}")]
    moments.append(F.avg(1 / F.col("n")).alias("per_n"))
    prior = hosts.agg(*moments)
    for r in rules:
        spread = F.col(f"mean_{r}") * (1 - F.col(f"mean_{r}"))
        between = F.col(f"var_{r}") - spread * F.col("per_n")
        strength = F.when(between > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), spread / between - 1))).otherwise(MOST)
        prior = prior.withColumn(f"strength_{r}", strength)
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    shrunk = lambda r: (F.col(f"f_{r}") + F.col(f"mean_{r}") * F.col(f"strength_{r}")) / (F.col("n") + F.col(f"strength_{r}"))
    return joined.select("host", "n", *(f"f_{r}" for r in rules), *(shrunk(r).alias(f"rate_{r}") for r in rules))


def judged(docs: DataFrame, rules: dict = HOST_RULES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts, base_failed, kept, host_rate (the shrunk rate of the base rules; null without a host)."""
    documents = stored(counted(docs, id_col, text_col, host_col), "counted")
    rates = host_rates(documents, rules)
    broken = F.lit(False)
    for r, (_, bound) in rules.items():
        broken = broken | (F.col(f"rate_{r}") > bound)
    first = next(iter(rules))
    hosts = stored(rates.select("host", "n", F.col(f"rate_{first}").alias("host_rate"), broken.alias("rejected")), "verdicts")
    out = with_group(documents, hosts, "host", "n", ["host_rate", "rejected"])
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return out.withColumn("kept", kept).withColumn("host_rate", F.round("host_rate", 6)).drop("rejected")


_SQL_RULES = {r: fails for r, (fails, _) in HOST_RULES.items()}
_BROKEN = " or ".join(f"rate_{r} > {bound}" for r, (_, bound) in HOST_RULES.items())
_RATES = ", ".join(f"(f_{r} + mean_{r} * strength_{r}) / (n + strength_{r}) rate_{r}" for r in HOST_RULES)
_STRENGTHS = ", ".join(f"case when var_{r} - mean_{r} * (1 - mean_{r}) * per_n > 0 then greatest({LEAST}, least({MOST}, mean_{r} * (1 - mean_{r}) / (var_{r} - mean_{r} * (1 - mean_{r}) * per_n) - 1)) else {MOST} end::double strength_{r}" for r in HOST_RULES)
SQL = rf"""
with d as materialized (select row_number() over () r, doc_id, source host, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
l as (select r, count(*) n_lines, count(distinct x) kinds from (select r, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
w as materialized (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] w from (select r, ws, unnest(range(1, len(ws) - 1)) i from d)),
a as (select r, i from w semi join (select r, w from w group by all having count(*) > 1) using (r, w)),
c as (select r, count(distinct p) n_repeat_words from (select r, unnest([i, i + 1, i + 2]) p from a) group by r),
n as materialized (select r, doc_id, host, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_lines - kinds, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words from d left join l using (r) left join c using (r)),
f as materialized (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed from n),
h as materialized (select host, count(*) n, {", ".join(f"count(*) filter ({fails}) f_{r}" for r, fails in _SQL_RULES.items())} from f where host is not null group by host),
p as (select avg(1.0::double / n) per_n, {", ".join(f"sum(f_{r})::double / sum(n) mean_{r}, var_pop(f_{r}::double / n) var_{r}" for r in HOST_RULES)} from h),
g as (select *, {_STRENGTHS} from p), v as (select host, {_RATES} from h, g)
select doc_id, f.host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, round(rate_base, 6) host_rate, not base_failed and not coalesce({_BROKEN}, false) kept from f left join v on f.host = v.host
"""
