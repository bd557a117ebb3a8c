"""URL filters by association rules.

A URL is the set of its tokens: host labels, path parts and names and values of the
query, in lower case, numbers all alike. FP-growth mines the token sets that
are frequent among labelled pages; a set that comes with a bad label at least as often
as the floor and with the confidence asked for is a rule, unless some of
its tokens alone are a rule of no less confidence. Tokens that are bad too seldom are no items; those that
occur in just the same labelled pages, as the parts of a template do, are one item while mining, whose rules then hold for each
of them: sets with two of them are redundant, so nothing is lost and mining is not exponential in a template's length. Rules are filed under their rarest
token, so a page is compared only with rules that it may match.

Nulls: a null or empty URL has no tokens, matches nothing and stays; a null label
is no label, a null id matches no label. Pages of one id share its label;
repeated rows are judged each; very long URLs are read whole. Without rules nothing is dropped, and an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch

#: Share of the labelled pages, and number, that must have a rule's tokens and be bad.
MIN_SUPPORT, MIN_COUNT = 0.002, 10
#: In thousandths, of the labelled pages with a rule's tokens those that must be bad.
MIN_CONFIDENCE = 500
BAD = "\0bad"


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL, without the scheme."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    parts = F.transform(F.split(bare, "[^a-z0-9\\-]+"), lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(t))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: int = MIN_CONFIDENCE) -> DataFrame:
    """(rule, seen, bad, confidence) from (tokens, bad): rules' tokens, labelled pages with them, bad ones, thousandths."""
    n = labelled.count()
    floor = max(ceil(min_support * n), min_count)
    # At most (tokens of a page) / min_support tokens are bad so often.
    each = labelled.withColumn("row", F.xxhash64(F.monotonically_increasing_id())).select("bad", "row", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("seen"), F.sum(F.col("bad").cast("long")).alias("bad"), F.bit_xor("row").alias("rows")).where(F.col("bad") >= floor).collect()
    if n < floor or not often:
        return labelled.select(F.col("tokens").alias("rule"), *[F.lit(0).cast("long").alias(c) for c in ("seen", "bad", "confidence")]).limit(0)
    alike: dict[tuple, list[str]] = {}
    for r in sorted(often, key=lambda r: r.token):
        alike.setdefault((r.seen, r.bad, r.rows), []).append(r.token)
    members = {m[0]: m for m in alike.values()}
    known = F.filter("tokens", lambda t: t.isin(list(members)))
    items = labelled.select(F.when(F.col("bad"), F.concat(known, F.array(F.lit(BAD)))).otherwise(known).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / n, minConfidence=1.0).fit(items)
    # Sets with the label and without it; a rule's parts are all among those that are bad often enough.
    sets = model.freqItemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("rule"), F.array_contains("items", BAD).alias("is_bad"), "freq").where(F.size("rule") > 0)
    counted = sets.groupBy("rule").agg(F.max(F.when(~F.col("is_bad"), F.col("freq"))).alias("seen"), F.max(F.when(F.col("is_bad"), F.col("freq"))).alias("bad"))
    scratch = Scratch(labelled.sparkSession, "urls")
    often = scratch.write(
        counted.where(F.col("bad") >= floor)
        .withColumn("confidence", F.floor(F.col("bad") * 1000 / F.col("seen"))).withColumn("is_rule", F.col("bad") * 1000 >= F.col("seen") * min_confidence)
    )
    # A rule is redundant if a part of it is a rule with as much confidence: the best of the parts follows, size by size, from those without one token.
    longest = often.where("is_rule").agg(F.max(F.size("rule"))).first()[0] or 0
    level = often.where(F.size("rule") == 1).withColumn("best", F.lit(-1).cast("long"))
    rules = level
    for size in range(2, longest + 1):
        known = level.select(F.col("rule").alias("part"), F.greatest("best", F.when(F.col("is_rule"), F.col("confidence"))).alias("upto"))
        more = often.where(F.size("rule") == size)
        parts = more.select("rule", F.explode(F.transform("rule", lambda t: F.array_remove("rule", t))).alias("part"))
        level = scratch.write(more.join(parts.join(known, "part").groupBy("rule").agg(F.max("upto").alias("best")), "rule"))
        rules = rules.unionByName(level)
    rules = rules.where(F.col("is_rule") & (F.col("best") < F.col("confidence"))).select("rule", "seen", "bad", "confidence")
    several = {k: m for k, m in members.items() if len(m) > 1}
    if not several:
        return rules
    table = F.create_map(*[x for k, m in several.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in m]))])
    choices = F.transform("rule", lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))
    every = F.aggregate(choices, F.array(F.array().cast("array<string>")), lambda sets, ts: F.flatten(F.transform(sets, lambda a: F.transform(ts, lambda t: F.concat(a, F.array(t))))))
    return rules.select(F.explode(every).alias("rule"), "seen", "bad", "confidence").withColumn("rule", F.array_sort("rule"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", **bounds) -> DataFrame:
    """(page_id, url, n_rules, confidence, drop) of every page: matching rules and the highest confidence, in thousandths."""
    flat = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), tokens(F.col(url_col)).alias("tokens"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min(label_col) == 0).alias("bad"))
    rules = mine(flat.join(known, "id").select("tokens", "bad"), **bounds)
    # The inverted index: each rule under its rarest token among the pages with labels; seen counts do for that.
    single = flat.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = (
        rules.select("rule", "confidence", F.explode("rule").alias("token")).join(single, "token")
        .groupBy("rule", "confidence").agg(F.min(F.struct("count", "token")).getField("token").alias("token"))
        .groupBy("token").agg(F.collect_list(F.struct("rule", "confidence")).alias("rules"))
    )
    urls = flat.select("url", "tokens").distinct()
    hits = (
        urls.withColumn("token", F.explode("tokens")).join(filed, "token")
        .select("url", F.explode(F.filter("rules", lambda r: F.size(F.array_except(r["rule"], F.col("tokens"))) == 0)).alias("r"))
        .groupBy("url").agg(F.count("*").alias("n_rules"), F.max("r.confidence").alias("confidence"))
    )
    return flat.join(hits, "url", "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"), F.col("n_rules").isNotNull().alias("drop"),
    )
