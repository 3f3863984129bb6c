"""URL filters: fixed host and path rules, then association rules mined from labels.

Every labelled URL is a transaction of its tokens, and Spark's FP-growth mines their combinations. Rules {tokens} -> bad with enough
support and confidence, and without a shorter rule that is as confident, are stored in an inverted index under
their rarest token. A page looks up its tokens there and is blocked if all tokens of a rule found are among its own.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import ascii_lower, decided_by_key, partitions, stored

#: action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and its action: of the rules that fit a host or one of its parent domains and start the path, the longest; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host, its last label, its first label and every label, first path part and every path part, ending of the path, keys of the query."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda k: F.concat(F.lit("key:"), k))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("label:"), x))
    steps = F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.concat(F.lit("path:"), x))
    single = F.array(
        F.concat(F.lit("scheme:"), F.substring_index(text, "://", 1)),
        F.concat(F.lit("host:"), host),
        F.concat(F.lit("tld:"), F.substring_index(host, ".", -1)),
        F.concat(F.lit("sub:"), F.substring_index(host, ".", 1)),
        F.concat(F.lit("dir:"), F.regexp_extract(path, r"^/([^/]*)", 1)),
        F.concat(F.lit("ext:"), F.regexp_extract(path, r"(\.[A-Za-z0-9]+|/)$", 1)),
        F.concat(F.lit("part:"), F.when(text.contains("#"), "fragment").otherwise("none")),
    )
    return F.when(host != "", F.array_distinct(F.concat(single, labels, steps, keys))).otherwise(F.array().cast("array<string>"))


#: Marks a bad URL in its transaction; no token is empty.
_BAD = ""
#: Up to so many entries (rules have a few tokens each) an index is broadcast, else it is joined.
BROADCAST = 20_000


def _items(rows: DataFrame, labelled_urls: int, least: int) -> DataFrame:
    """token, item, n, bad of the tokens that a rule may have: those of `least` bad urls at least that are not in every url.

    Tokens with the same urls (by count, bad urls and two 64-bit sums over the urls) are one item, the first of them: FP-growth need not tell them apart.
    """
    mark = [F.bit_xor(F.xxhash64("url", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    tokens_of = rows.select("url", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), *mark)
    tokens_of = stored(tokens_of.filter((F.col("bad") >= least) & (F.col("n") < labelled_urls)), "tokens")
    same = ["n", "bad", "x1", "x2"]
    return stored(tokens_of.join(tokens_of.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "n", "bad"), "items")


def _frequent(rows: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """items (sorted), n, bad of the itemsets with `least` bad urls at least, by FP-growth over transactions of items and the mark of bad urls."""
    spark = rows.sparkSession
    exploded = rows.select("url", "bad", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    baskets = exploded.groupBy("url", "bad").agg(F.collect_set("item").alias("items"))
    baskets = stored(baskets.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    total = baskets.count()
    if total < least:
        return spark.createDataFrame([], "items array<string>, n long, bad long")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, numPartitions=partitions(spark)).fit(baskets)
    found = stored(model.freqItemsets, "frequent")
    bad = found.filter(F.array_contains("items", _BAD) & (F.size("items") > 1))
    bad = bad.select(F.array_sort(F.array_remove("items", _BAD)).alias("items"), F.col("freq").alias("bad"))
    every = found.filter(~F.array_contains("items", _BAD)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    return stored(every.join(bad, "items"), "itemsets")


def _general(sets: DataFrame) -> DataFrame:
    """Adds `best`, the highest confidence of an itemset's proper parts: level by level from the itemsets that have one item less."""
    longest = sets.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    sets = sets.withColumn("confidence", F.col("bad") / F.col("n"))
    now = stored(sets.filter(F.size("items") == 1).withColumn("best", F.lit(-1.0)), "level-1")
    done = now
    for size in range(2, longest + 1):
        level = sets.filter(F.size("items") == size)
        parts_of = level.select("items", F.explode("items").alias("one")).select("items", F.array_remove("items", F.col("one")).alias("part"))
        best = parts_of.join(now.select(F.col("items").alias("part"), F.greatest("confidence", "best").alias("best")), "part").groupBy("items").agg(F.max("best").alias("best"))
        now = stored(level.join(best, "items"), f"level-{size}")
        done = done.unionByName(now)
    return done


def rules_of(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """Rules from rows (tokens, bad), mined by FP-growth: items, confidence, support, anchor (the rarest item); and the tokens' items. None where fewer than `min_count` urls are labelled.

    A rule needs the support and at least `min_count` bad urls, so that a few labels do not make rules of single pages, and more confidence than any of its parts
    and than all urls. Tokens without that support are counted and left out first: no rule can have them. A token that only bad urls have is a
    rule by itself, and longer rules with it would be none: it takes no part in the mining. Itemsets and rules stay in tables; the driver sees counts only. Their number grows
    with two to the power of the items that many urls share, as FP-growth's does.
    """
    rows = labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("url"), "tokens", F.col("bad").cast("int").alias("bad"))
    rows = stored(rows, "labelled")
    labelled_urls, bad_urls = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if labelled_urls < min_count:
        return None
    least = max(min_count, math.ceil(min_support * labelled_urls - 1e-9))
    items = _items(rows, labelled_urls, least)
    sure = items.filter("bad = n").groupBy("item").agg(F.max("n").alias("n"))
    sure = sure.select(F.array("item").alias("items"), "n", F.col("n").alias("bad"), F.lit(1.0).alias("confidence"), F.lit(-1.0).alias("best"))
    sets = _general(_frequent(rows, items.filter("bad < n"), least)).unionByName(sure)
    rules = sets.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("best")) & (F.col("bad") * labelled_urls > bad_urls * F.col("n")))
    rules = stored(rules.withColumn("support", F.col("bad") / labelled_urls), "rules")
    # the item with the fewest urls has the fewest look-ups
    counts = items.filter("token = item").select("item", F.col("n").alias("item_n"))
    rarest = rules.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min_by("item", F.struct("item_n", "item")).alias("anchor"))
    return rules.join(rarest, "items").select("items", "confidence", "support", "anchor"), items.select("token", "item")


def mined(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 10) -> DataFrame | None:
    """The rules of `rules_of` written out in tokens, for reading: rule_tokens, confidence, support. An item that stands for several tokens gives a rule for each of them."""
    found = rules_of(labelled, min_support, min_confidence, min_count)
    if found is None:
        return None
    rules, items = found
    names = rules.select("items", "confidence", "support", F.explode("items").alias("item")).join(items, "item")
    names = names.groupBy("items", "confidence", "support", "item").agg(F.collect_list("token").alias("names")).groupBy("items", "confidence", "support").agg(F.collect_list("names").alias("names"))
    product = F.aggregate("names", F.array(F.array().cast("array<string>")), lambda done, more: F.flatten(F.transform(done, lambda x: F.transform(more, lambda y: F.array_append(x, y)))))
    return names.select(F.explode(product).alias("rule_tokens"), "confidence", "support").withColumn("rule_tokens", F.array_sort("rule_tokens"))


def _sized(df: DataFrame) -> DataFrame:
    """To be broadcast if it is small enough, as counted; else joined by key."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def judged(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    label_id: str = "doc_id", min_support: float = 0.002, min_confidence: float = 0.6,
) -> DataFrame:
    """One row a page: page_id, host, path, rule (null: none fits), verdict, confidence (of the best mined rule; null: none).

    A label is bad where toxic is 1 or quality is 0; of several labels of one page any bad one counts, null labels are not bad.
    Pages with a null id take part without a label. Null urls have no tokens and are allowed. Without labels only the
    fixed rules decide. Repeated rows are judged alike; an empty table gives no rows.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marked = labels.groupBy(F.col(label_id).alias("id")).agg(F.max(bad).alias("bad"))
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    rule, action = listed_rule(F.col("host"), F.col("path"), rules)

    found = rules_of(rows.join(marked, "id").select("tokens", "bad"), min_support, min_confidence)
    if found is None:
        best = F.lit(None).cast("double")
    else:
        rules, items = found
        items = stored(items.join(rules.select(F.explode("items").alias("item")).distinct(), "item", "left_semi"), "rule-items")
        index = stored(rules.groupBy("anchor").agg(F.collect_list(F.struct("confidence", "items")).alias("posting")), "index")
        urls = rows.filter(F.size("tokens") > 0).groupBy("url").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("pages"))
        urls = urls.select("url", "pages", F.explode("tokens").alias("token")).join(_sized(items), "token").groupBy("url").agg(F.collect_set("item").alias("own"), F.max("pages").alias("pages"))
        fits = F.filter("posting", lambda r: F.size(F.array_except(r["items"], F.col("own"))) == 0)
        hits = (
            urls.select("url", "pages", "own", F.explode("own").alias("anchor")).join(_sized(index), "anchor")
            .select("url", "pages", F.array_max(F.transform(fits, lambda r: r["confidence"])).alias("confidence"))
            .filter("confidence is not null").groupBy("url").agg(F.max("confidence").alias("confidence"), F.max("pages").alias("pages"))
        )
        rows = decided_by_key(rows, stored(hits, "hits"), "url", "confidence", "pages")
        best = F.col("confidence")
    return rows.select(
        F.col("id").alias("page_id"), "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(best.isNotNull(), "block").otherwise("allow")).alias("verdict"),
        best.alias("confidence"),
    )
