"""URL filters by association rules.

The urls that the labels mark as unwanted are transactions of url tokens;
FP-growth finds the token combinations with enough support among them, the
labelled urls that hold a combination give its confidence, and rules below the
confidence or support bound are pruned, as are rules that a more general rule
covers.  Combinations match urls by an inverted index: every rule is listed
under its rarest token, so a url meets a rule by one equi-join on a token and is
then verified.  Fixed host/path rules come first; the longest one wins.

Defined cases: a null url, or one without "://", has empty host and path and the
one token "(none)"; labels with null ids or values are ignored, repeated labels
count once (the larger value); without positive labels there are no mined rules;
repeated pages each get a row; urls of any length are matched whole; tokens that
always stand together are mined as one and each stands for the others in a rule;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.durable import durable
from refloom.llm.text import ascii_lower

#: Fixed rules of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: A combination needs so many unwanted urls, and so large a share of all
#: labelled urls that hold it.
MIN_COUNT = 20
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: The index travels with the tasks up to so many rules; beyond, urls are shuffled by token.
BROADCAST_RULES = 50_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host, its parents, path words, query keys; digits as 0."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parents = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: i <= F.size(labels)),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    words = F.transform(F.filter(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "0"), "[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    every = F.array_distinct(F.concat(parents, words, keys))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("(none)")))


def fixed_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    out = None
    for at, prefix, verdict in ranked:
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        struct = F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, struct) if out is None else out.when(fits, struct)
    return out


def mine_rules(
    labelled: DataFrame,
    min_count: int = MIN_COUNT,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Pruned rules from (tokens, unwanted): items (sorted), support, confidence."""
    spark = labelled.sparkSession
    positive = labelled.filter("unwanted").select(F.col("tokens").alias("items"))
    n, n_all = positive.count(), labelled.count()
    least = max(min_count, min_support * n)
    if n < least:
        return spark.createDataFrame([], "items array<string>, support bigint, confidence double")
    # tokens that stand in the very same labelled urls are mined as one, else k of them make 2**k combinations
    held = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(38,0)").alias("url"))
    prints = held.groupBy("token").agg(F.count("*").alias("n"), F.sum("url").alias("print"))
    twins = durable(prints.groupBy("n", "print").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("twins")).select("token", "twins"), "twins")
    numbered = positive.withColumn("_row", F.monotonically_increasing_id())
    narrow = numbered.select("_row", F.explode("items").alias("token")).join(twins.select("token"), "token", "left_semi").groupBy("_row").agg(F.collect_list("token").alias("items"))
    sets = FPGrowth(minSupport=least / n, minConfidence=min_confidence).fit(narrow.select("items")).freqItemsets
    sets = durable(sets, "itemsets")
    sets = sets.filter(F.col("freq") >= least).select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
    seen = match(labelled.select("tokens"), sets.select("items")).groupBy("items").agg(F.count("*").alias("of"))
    rules = sets.join(seen, "items").withColumn("confidence", F.col("support") / F.col("of")).filter(F.col("confidence") >= min_confidence)
    # a rule is dropped if leaving out one of its tokens gives a rule of no less confidence
    shorter = rules.select(F.col("items").alias("whole"), F.col("confidence").alias("c"), F.explode("items").alias("out"))
    shorter = shorter.select("whole", "c", F.array_remove("whole", F.col("out")).alias("items"))
    covered = shorter.join(rules.select("items", "confidence"), "items").filter("confidence >= c").select(F.col("whole").alias("items")).distinct()
    base = F.lit(n / max(n_all, 1))
    kept = rules.join(covered, "items", "left_anti").filter(F.col("confidence") > base).select("items", "support", "confidence")
    # every token stands for its twins again
    choices = kept.select("*", F.explode("items").alias("token")).join(twins, "token").groupBy("items", "support", "confidence").agg(F.collect_list("twins").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate("choices", none, lambda sets, some: F.flatten(F.transform(sets, lambda x: F.transform(some, lambda y: F.concat(x, F.array(y))))))
    return choices.select(F.explode(every).alias("items"), "support", "confidence").withColumn("items", F.array_sort("items"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (with tokens) joined with every rule whose items they hold."""
    common = rules.select(F.explode("items").alias("token")).groupBy("token").count()
    listed = (
        rules.withColumn("_rule", F.col("items"))
        .select("*", F.explode("_rule").alias("token"))
        .join(common, "token")
        .groupBy(*rules.columns)
        .agg(F.min_by("token", F.struct("count", "token")).alias("anchor"))
    )
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    posted = urls.select("*", F.explode("tokens").alias("anchor"))
    held = F.size(F.array_intersect("items", "tokens")) == F.size("items")
    return posted.join(listed, "anchor").filter(held).drop("anchor")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    **bounds,
) -> DataFrame:
    """One row per page: host, path, rule, verdict, and the best mined rule.

    ``labels`` mark page ids as unwanted (1) or not (0).  A page that no fixed
    rule decides is blocked if a mined rule fits, else allowed.
    """
    marks = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg((F.max(label_col) > 0).alias("unwanted"))
    url = F.col(url_col)
    urls = pages.select(F.col(id_col), url.alias("_url"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    parts = [F.col("_host"), F.col("_path"), F.col("_url")]
    labelled = urls.join(marks, urls[id_col] == marks["_id"]).select(tokens(*parts).alias("tokens"), "unwanted")
    mined = durable(mine_rules(durable(labelled, "labelled"), **bounds), "rules")
    distinct = urls.drop(id_col).distinct().select("_url", tokens(*parts).alias("tokens"))
    best = match(distinct, mined).groupBy(F.col("_url").alias("_of")).agg(F.max_by(F.struct("items", "confidence"), F.struct("confidence", "support", "items")).alias("mined"))
    return (
        urls.withColumn("fixed", fixed_verdict(F.col("_host"), F.col("_path"), rules))
        .join(best, F.col("_url").eqNullSafe(F.col("_of")), "left")
        .select(
            id_col,
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("fixed.rule").alias("rule"),
            F.coalesce("fixed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            F.col("mined.items").alias("mined_rule"),
            F.col("mined.confidence").alias("confidence"),
        )
    )
