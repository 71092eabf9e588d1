"""URL filter: host and path rules first, then a ratio of two character language models. DataFrame operations only.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path: then up to `?`, `#` or the end. A rule fits
its host and all subdomains if the path starts with the rule's; the longest wins (equally long: the smaller by code point).

The URLs that rules allow and those that they block train one variable-order Markov model each, over `host + path`
written in a reduced alphabet (a-z, one digit sign, punctuation, one sign for the rest), so a model's size is bounded by
the alphabet: at most ALPHABET ** (ORDER + 1) entries. Orders are smoothed into each other:
p(c | s) = (n(s, c) + STRENGTH * p(c | s without its first sign)) / (n(s) + STRENGTH), so signs that training never saw
after a context back off to shorter ones. A URL without a rule is blocked if its mean log ratio, blocked over allowed,
exceeds the threshold at which both groups of training URLs lie equally many standard deviations off. There each training
URL is judged by the models of the other half of them (halves by a hash of the URL's signs), never by its own.

Null URL or none with `://`: host and path are empty, no rule, allowed. If either group of training URLs is empty, all
without a rule are allowed. Null page_id: kept. Repeated rows: one result row each. Very long URLs: judged whole. Empty table: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, heavy_keys, materialize, small

#: The rules of the contract, (verdict, rule).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
ORDER = 3
STRENGTH = 4.0
#: Grams whose ratios may be broadcast; beyond (at most ALPHABET ** (ORDER + 1)) their join shuffles.
BROADCAST_GRAMS = 300_000
#: Signs of the reduced alphabet: a-z, 0 for digits, these, and ~ for all others; ^ begins a URL.
PUNCTUATION = "./-_%:&+=@"
ALPHABET = 26 + 1 + len(PUNCTUATION) + 2


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule and its verdict (null, null without any)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def reduced(text: Column) -> Column:
    x = F.regexp_replace(lower_ascii(text), "[0-9]", "0")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(x, "[^a-z0" + "".join("\\" + c for c in PUNCTUATION) + "]", "~"))


def grams(rows: DataFrame) -> DataFrame:
    """A row for each sign of `signs`: gram is it with the ORDER signs before it. Rows with no sign give none."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length("signs") - ORDER, F.lit(1))), lambda i: i <= F.length("signs") - ORDER)
    return rows.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring("signs", i, F.lit(ORDER + 1)))))


#: Models: of all training URLs, of those of half 1 (which judge half 0), of those of half 0.
MODELS = {"all": (0, 1), "h0": (1,), "h1": (0,)}


def model(seen: DataFrame) -> DataFrame:
    """(gram, all, h0, h1): log2 of the blocked over the allowed probability of each gram in seen (gram, n00, n01, n10, n11; materialised), by each of MODELS.

    n<b><h> counts the gram in training URLs that are blocked (b) and in half h; it may be 0 everywhere. Every order's
    counts are sums over this bounded table.
    """
    names = [f"{m}{b}" for m in MODELS for b in (0, 1)]
    counts = seen.select("gram", *(sum((F.col(f"n{b}{h}") for h in halves[1:]), F.col(f"n{b}{halves[0]}")).alias(f"{m}{b}") for m, halves in MODELS.items() for b in (0, 1)))
    out = counts.select("gram", *names, *(F.lit(1.0 / ALPHABET).alias(f"p{x}") for x in names))
    for k in range(ORDER + 1):
        tail, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        here = out.withColumn("context", context)
        here = here.join(F.broadcast(counts.groupBy(context.alias("context")).agg(*(F.sum(x).alias(f"s{x}") for x in names))), "context")  # at most ALPHABET ** ORDER rows
        if k < ORDER:
            sums = counts.groupBy(tail.alias("tail")).agg(*(F.sum(x).alias(f"a{x}") for x in names))
            here = here.withColumn("tail", tail).join(F.broadcast(sums), "tail")  # at most ALPHABET ** ORDER rows
        own = (lambda x: F.col(f"a{x}")) if k < ORDER else F.col  # the longest tail is the gram itself
        out = here.select("gram", *names, *(((own(x) + STRENGTH * F.col(f"p{x}")) / (F.col(f"s{x}") + STRENGTH)).alias(f"p{x}") for x in names))
    return materialize(out.select("gram", *(F.log2(F.col(f"p{m}1") / F.col(f"p{m}0")).alias(m) for m in MODELS)))


def ratios(rows: DataFrame) -> DataFrame:
    """(row, all, h0, h1): each row's mean log ratio by each of MODELS; rows (row, signs, half, blocked), those with a null in blocked don't train."""
    each = grams(rows.select("row", "signs", "half", "blocked"))
    in_group = lambda b, h: F.sum(F.when((F.col("blocked") == bool(b)) & (F.col("half") == h), 1).otherwise(0)).cast("double")
    seen = materialize(each.groupBy("gram").agg(F.count("*").alias("n"), *(in_group(b, h).alias(f"n{b}{h}") for b in (0, 1) for h in (0, 1))))
    fitted = model(seen)
    heavy = None if seen.count() <= BROADCAST_GRAMS else heavy_keys(seen.select("gram", "n"), ["gram"])
    return heavy_join(each.select("row", "gram"), small(fitted, BROADCAST_GRAMS), ["gram"], heavy).groupBy("row").agg(*(F.avg(m).alias(m) for m in MODELS))


def threshold(trained: DataFrame) -> float:
    """The ratio that lies equally many standard deviations off both groups; trained: (blocked, ratio), where a group without any ratio gives 0."""
    spread = {r.blocked: (r.m, r.s) for r in trained.groupBy("blocked").agg(F.avg("ratio").alias("m"), F.stddev_pop("ratio").alias("s")).where("m is not null").collect()}
    if set(spread) != {True, False}:
        return 0.0
    (m0, s0), (m1, s1) = spread[False], spread[True]
    return (m0 * (s1 + 1e-9) + m1 * (s0 + 1e-9)) / (s0 + s1 + 2e-9)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, log_ratio (null where a rule decides or nothing was learned) for each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    signs = reduced(F.concat("host", "path"))
    ruled = materialize(rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("signs", signs).withColumn("half", F.pmod(F.xxhash64("signs"), F.lit(2)).cast("int")).withColumn("blocked", F.col("by_rule") == "block"))
    groups = {r.blocked for r in ruled.groupBy("blocked").count().collect()}
    if not groups >= {True, False}:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("log_ratio"))
    judged = materialize(ratios(ruled))
    both = ruled.join(judged, "row", "left")
    held = F.when(F.col("half") == 0, F.col("h0")).otherwise(F.col("h1"))
    cut = threshold(both.where(F.col("blocked").isNotNull()).select("blocked", held.alias("ratio")))
    ratio = F.when(F.col("blocked").isNull(), F.col("all"))
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(ratio > cut, "block").otherwise("allow")).alias("verdict"), ratio.alias("log_ratio"))
