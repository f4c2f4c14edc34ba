"""URL filters: association rules over URL tokens, mined by Spark's FP-growth.

Labelled URLs become transactions of tokens (host labels, host suffixes, path
segments, file extension, query keys; runs of digits read ``#``) plus their
label.  FP-growth finds the combinations that bad URLs share; a rule is a
combination whose share of bad URLs (confidence) and whose count of URLs
(support) reach their limits, and which isn't implied by a shorter rule of no
lower confidence.  Tokens that always occur together are mined as one.

Matching is an inverted index: each rule is filed under its rarest token, URL
tokens are joined to that index, and a rule fires if the URL holds all its
tokens.  Everything runs in Spark's own operators.

Explicit rules (host suffix and path prefix, longest wins) come first.

Defined results: host and path of a null URL or one without ``://`` are empty,
and such a URL has no tokens: it is allowed unless a rule says otherwise;
labels of unknown URLs and null labels don't count; repeated rows are judged
one by one; without labelled URLs no rule is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

MIN_COUNT = 20
MIN_CONFIDENCE = 0.6


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` host label, ``d:`` last two labels, ``p:`` path
    segment with its place, ``e:`` file extension, ``q:`` query key."""
    blank = lambda c: F.filter(c, lambda x: x != "")
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    labels = blank(F.split(host, r"\."))
    segments = blank(F.split(path, "/"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(blank(F.split(query, "&")), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), F.substring_index(host, ".", -2))))
        .otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), digits(x))),
        F.when(extension != "", F.array(F.concat(F.lit("e:"), extension))).otherwise(F.array().cast("array<string>")),
        keys))


def fold_tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, tokens, bad) with one token of each set that always occurs
    together, and those sets: ``token`` and ``members``.

    Equal URLs of many tokens would otherwise give a combination for every
    subset of them.  Sets are found by count and sums of row hashes, and then
    proved: every row with one member must hold the first one."""
    one = rows.select("id", "tokens", F.explode("tokens").alias("token"))
    marks = one.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright(F.xxhash64(F.lit(k), "id"), 20)).alias(f"s{k}") for k in range(3)])
    sets = marks.groupBy("n", "s0", "s1", "s2").agg(F.sort_array(F.collect_list("token")).alias("members"))
    sets = cut(sets.select(F.get("members", F.lit(0)).alias("first"), "members"), "token-sets")
    of = sets.where(F.size("members") > 1).select("first", "members", F.explode("members").alias("token"))
    broken = one.join(of, "token").where(~F.array_contains("tokens", F.col("first"))).select("first").distinct()
    right = of.join(broken, "first", "left_anti")
    folded = cut(one.join(right.select("token", "first"), "token", "left")
                 .where("first IS NULL OR first = token")
                 .groupBy("id").agg(F.collect_list("token").alias("tokens")), "folded")
    return (folded.join(rows.select("id", "bad"), "id"),
            cut(right.where("first = token").select("token", "members"), "fold"))


def mine_rules(labelled: DataFrame, *, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(rule_id, tokens, n, confidence)`` from ``(tokens, bad)`` rows.

    A rule of ``min_count`` URLs and ``min_confidence`` holds in at least their
    product of bad URLs, so combinations are mined from the bad URLs only, by
    that count at every table size and without a bound on their length; how often
    they occur in all URLs is then counted through the index."""
    rows = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(
        F.monotonically_increasing_id().alias("id"), "tokens", "bad")
    rows = cut(rows, "transactions")
    bad = rows.where("bad").count()
    least = max(1, math.ceil(min_count * min_confidence - 1e-9))
    if bad < least:
        none = labelled.sparkSession.range(0)
        return none.select(F.col("id").alias("rule_id"), F.array(F.lit("")).alias("tokens"), F.col("id").alias("n"),
                           F.lit(0.0).alias("confidence"))
    rows, fold = fold_tokens(rows)
    rows = cut(rows, "folded-rows")
    # Half a row less, so that rounding can't lift the limit above ``least`` rows.
    sets = FPGrowth(itemsCol="tokens", minSupport=(least - 0.5) / bad, minConfidence=min_confidence).fit(
        rows.where("bad")).freqItemsets
    sets = cut(sets.select(F.sort_array("items").alias("items"), F.col("freq").alias("bad"),
                           F.xxhash64(F.sort_array("items")).alias("rule_id")), "itemsets")
    # Occurrences in all rows, equal token lists once: sets are filed under their rarest token.
    lists = cut(rows.groupBy(F.sort_array("tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("_rows")), "lists")
    posted = lists.select("tokens", "_rows", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.sum("_rows").alias("n"))
    one = sets.select("rule_id", "items", "bad", F.explode("items").alias("token"))
    filed = one.join(often, "token").groupBy("rule_id", "items", "bad").agg(F.min(F.struct("n", "token")).alias("_r")).select(
        "rule_id", "items", "bad", F.col("_r.token").alias("token"))
    rules = (posted.join(filed, "token").where(F.size(F.array_except("items", "tokens")) == 0)
             .groupBy("rule_id", "items", "bad").agg(F.sum("_rows").alias("freq"))
             .withColumn("confidence", F.col("bad") / F.col("freq"))
             .where((F.col("freq") >= min_count) & (F.col("confidence") >= min_confidence)))
    rules = cut(rules.select("rule_id", "items", "freq", "confidence"), "rules")
    # A shorter rule that shares a token and is contained in the longer one, at no lower confidence, implies it.
    by_token = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token"))
    implied = (by_token.alias("l").join(by_token.alias("s"), "token")
               .where((F.size("s.items") < F.size("l.items")) & (F.col("s.confidence") >= F.col("l.confidence"))
                      & (F.size(F.array_except("s.items", "l.items")) == 0))
               .select(F.col("l.rule_id").alias("rule_id")).distinct())
    left = rules.join(implied, "rule_id", "left_anti")
    # Folded tokens stand for all members again.
    whole = left.select("rule_id", "freq", "confidence", F.explode("items").alias("token")).join(fold, "token", "left").select(
        "rule_id", "freq", "confidence", F.explode(F.coalesce("members", F.array("token"))).alias("token"))
    return whole.groupBy("rule_id", "freq", "confidence").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(
        "rule_id", "tokens", F.col("freq").alias("n"), "confidence")


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules, filed under ``token``: their rarest one (``tokens``: token, n)."""
    one = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    rare = (one.join(tokens, "token").groupBy("rule_id", "tokens", "confidence")
            .agg(F.min(F.struct("n", "token")).alias("_rare")))
    return rare.select("rule_id", F.col("tokens").alias("rule_tokens"), "confidence",
                       F.col("_rare.token").alias("token"))


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct token list in ``urls`` that a rule blocks: the list, the
    highest confidence and the number of rules.  Equal lists are matched once."""
    lists = cut(urls.groupBy("tokens").agg(F.count(F.lit(1)).alias("_rows")), "token-lists")
    posted = lists.select("tokens", "_rows", F.explode("tokens").alias("token"))
    counts = posted.join(rules.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    index = cut(rule_index(rules, counts.groupBy("token").agg(F.sum("_rows").alias("n"))), "index")
    hits = (posted.join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
            .groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_rules")))
    return cut(hits, "hits")  # of known size, so that Spark can broadcast it to the URLs where it is small


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str]], *, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, confidence and n_rules for every row."""
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    src = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    src = src.withColumns({"host": host, "path": path}).withColumn(
        "tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    hits = fired(src.select("tokens"), rules)
    return src.join(hits, "tokens", "left").select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("n_rules").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
