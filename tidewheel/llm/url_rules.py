"""URL filtering by association rules mined from labels.

Every url becomes a set of tokens: scheme, host labels, path segments (numbers as
one token), file ending and query parameter names. Spark's FP-growth mines token
combinations of labelled urls together with their class; rules that conclude
"block" and pass the support, confidence and lift thresholds are kept, and a rule
whose antecedent contains that of a kept rule of no less confidence is pruned. An
inverted index from each rule's rarest token finds the rules a url may match; a
rule matches if all its tokens are there. A url that matches a rule is blocked.

Support is a part of the labelled urls and at least LEAST of them, so a url seen once or
twice makes no rule on a small table either; and the lower end of the confidence's
interval must be above the share of bad urls. The interval is wide enough for all the
combinations that were looked at (Bonferroni's correction), so one that chance alone makes
out of that many is pruned, and labels that have nothing to do with urls give no rules.
All tokens of a labelled url that enough others have take part. Tokens that are in exactly the
same labelled urls are one item in mining, and a rule found for it holds for each of them: a
combination of two of them is no surer than either and would be pruned, so no rule is lost, and
a long path that urls share gives one item. Urls with many tokens of which none are in the same
urls give as many combinations as they have, exponentially many.
Judging uses all tokens of all urls.

A fixed list of host and path rules comes before the mined ones.

Only DataFrame functions and Spark's own FP-growth are used. The rules are a
written table, which Spark broadcasts only if it is below the session's threshold.

Defined results: a null url, or one without "://", has an empty host and path,
fits no fixed rule, has no tokens and is allowed; repeated rows get equal verdicts;
pages without labels, or no labels at all, are judged by what rules there are;
several labels of one page count as one, bad if any is bad; of several rules that match
the surest counts, then the one of most support, then the larger rule_id; very long urls
are judged whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import string
import sys
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.session import table
from tidewheel.storage import cut

#: The filter's fixed rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
#: Labelled urls that a rule must hold for at least, whatever their number.
LEAST = 5
#: Tokens of a labelled url that itemsets are made of: no bound.
MOST = sys.maxsize
#: The probability that chance makes any rule at all, about.
CHANCE = 0.01
BLOCK, ALLOW = "class:block", "class:allow"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The set of tokens of a url; empty for null."""
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    path = path_of(url)
    segments = F.transform(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda x: F.regexp_replace(x, r"^\d+$", "#"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    found = F.concat(
        tagged("scheme:", F.array(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))),
        tagged("host:", F.split(host_of(url), r"\.")),
        tagged("path:", segments),
        tagged("ending:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        tagged("query:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def telling(labelled: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(items, bad) of each row of (tokens, bad), and (token, n, members): the items, for tokens in at least ``least`` rows, and the tokens that are in the same rows as each.

    Rows are compared by their number and two sums of 64 bits over them.
    """
    rows = labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")
    rows = cut(rows, "labelled")
    terms = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    seen = terms.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit("two"), "row")).alias("two"))
    # As many members as a url has tokens, at most.
    items = seen.where(F.col("n") >= least).groupBy("n", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("members"))
    items = cut(items.select(F.col("members")[0].alias("token"), "n", "members"), "items")
    own = terms.join(items.select("token"), "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"))
    return rows.join(own, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad"), items


def errors(tried: int, chance: float = CHANCE) -> float:
    """Standard errors that chance exceeds in one of so many tries with a probability of ``chance`` at most."""
    return NormalDist().inv_cdf(1 - chance / max(tried, 1))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    least: int = LEAST,
    chance: float = CHANCE,
) -> DataFrame:
    """(rule_id, antecedent, confidence, support, anchor) mined from (tokens, bad).

    anchor is the antecedent's rarest token, by its own support among the labelled rows.
    """
    baskets, items = telling(labelled, least)
    baskets = baskets.select(F.concat("items", F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items"))
    spark = labelled.sparkSession
    empty = "rule_id long, antecedent array<string>, confidence double, support double, anchor string"
    n = baskets.count()
    if n < max(least, 1):
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    # Wilson's lower bound of the confidence, from the urls the antecedent is in; lift tells the share of bad urls.
    tried = model.freqItemsets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).count()
    c, m, z = F.col("confidence"), F.col("support") * n / F.col("confidence"), errors(tried, chance)
    low = (c + z * z / (2 * m) - z * F.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    found = cut(
        model.associationRules.where(
            (F.col("consequent") == F.array(F.lit(BLOCK))) & (F.col("lift") >= min_lift) & (low >= c / F.col("lift"))
        ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"),
        "rules",
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    terms = found.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = terms.groupBy("antecedent").agg(
        F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.min_by("token", F.struct("freq", "token")).alias("anchor")
    )
    # Pruned: rules that a more general rule, at least as sure, already covers. Both are in the general rule's posting list.
    general = rarest.select(F.col("antecedent").alias("shorter"), F.col("confidence").alias("sure"), F.col("anchor").alias("token"))
    covered = (
        terms.join(general, "token")
        .where(
            (F.size("shorter") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("shorter", "antecedent")) == 0)
        )
        .select("antecedent")
    )
    kept = rarest.join(covered, "antecedent", "left_anti").drop("anchor")
    # Each item of a rule stands for any one of its members.
    parts = kept.withColumn("token", F.explode("antecedent")).join(items, "token").groupBy("antecedent", "confidence", "support")
    parts = parts.agg(F.collect_list(F.transform("members", lambda t: F.struct("n", t.alias("token")))).alias("parts"))
    some = "array<array<struct<n:bigint,token:string>>>"
    chosen = F.aggregate("parts", F.array(F.array()).cast(some), lambda ways, own: F.flatten(F.transform(ways, lambda w: F.transform(own, lambda t: F.concat(w, F.array(t))))))
    every = parts.select("confidence", "support", F.explode(chosen).alias("way"))
    every = every.select("confidence", "support", F.array_sort("way.token").alias("antecedent"), F.array_min("way")["token"].alias("anchor"))
    return cut(every.withColumn("rule_id", F.xxhash64("antecedent")).select(*[c.split()[0] for c in empty.split(", ")]), "kept-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence): for each distinct url that matches, its surest rule."""
    posting = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    hits = posting.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max_by(F.struct("rule_id", "confidence"), F.struct("confidence", "support", "rule_id"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", "best.*")


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages whose page_id has a label; bad: of low quality or toxic."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad")
    )
    return pages.select("page_id", "url").join(bad, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "bad")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each row of pages (page_id, url)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": rule, "fixed": verdict})
    mined = mine_rules(label_pages(pages, labels), **mining)
    asked = rows.where(F.col("fixed").isNull()).select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    hits = matches(asked, mined).withColumnRenamed("rule_id", "mined_rule")
    return rows.join(hits, "url", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("fixed", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_url_rules": op10_url_rules}
ORACLE_SQL: dict[str, str] = {}
