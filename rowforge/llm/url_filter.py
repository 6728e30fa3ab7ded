"""URL filter: rules first, then the likelihood ratio of two character models.

Rules name a host and a path; the longest that fits decides, and what they decide teaches two smoothed Markov
models of variable order, one of allowed and one of blocked URLs. A character's probability after its last three
is a count estimate that falls back, order by order, on shorter contexts. A URL's score is the sum of the log
ratios by its length; a part of the decided URLs is held out of the counts and sets the threshold.

The models are tables of 4-grams over an alphabet of ``len(ALPHABET) + 3`` symbols, so they have a largest size
(about 4 million rows) whatever the input, and are broadcast. URLs are scored once for each different text.
Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialise

#: Characters that the models tell apart; digits count as one, all others as ``~``.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:?=&_%#-"
#: Weight of the shorter context's estimate, as a number of observations.
GAMMA = 2.0
#: One in so many decided URLs sets the threshold and is not counted.
HELD_OUT = 5
#: Steps in which the threshold is looked for.
BINS = 512


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, "host/path") that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        on, _, under = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{under}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def normal(url: Column) -> Column:
    """The URL in the models' alphabet, between three marks of its begin and one of its end."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.translate(F.coalesce(url, F.lit("")), upper, upper.lower()), "123456789", "0" * 9)
    return F.concat(F.lit("^^^"), F.regexp_replace(low, f"[^{ALPHABET[:-1]}-]", "~"), F.lit("$"))


def grams(text: Column) -> Column:
    """The 4-gram that ends at each character after the begin marks."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - 3), lambda i: F.substr(text, i, F.lit(4)))


def model(counted: DataFrame) -> DataFrame:
    """From (gram, good, bad) of 4-grams: (gram, ratio), the log of its last character's probabilities' ratio.

    P0 is uniform over the alphabet, P1 the character's own frequency, P2 to P4 follow one to three characters;
    each is (count + GAMMA * shorter estimate) / (context's count + GAMMA).
    """
    letters = float(len(ALPHABET) + 3)
    for order in range(4):
        part = counted.groupBy(F.substring("gram", 4 - order, order + 1).alias(f"g{order}")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = part.groupBy(F.substring(f"g{order}", 1, order).alias(f"c{order}")).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        part = part.withColumn(f"c{order}", F.substring(f"g{order}", 1, order)).join(F.broadcast(context), f"c{order}")
        if order == 0:
            good = bad = F.lit(1 / letters)
        else:
            part = part.withColumn(f"g{order - 1}", F.substring(f"g{order}", 2, order)).join(F.broadcast(last), f"g{order - 1}")  # noqa: F821
            good, bad = F.col("p_good"), F.col("p_bad")
        last = part.select(
            f"g{order}",
            ((F.col("good") + GAMMA * good) / (F.col("all_good") + GAMMA)).alias("p_good"),
            ((F.col("bad") + GAMMA * bad) / (F.col("all_bad") + GAMMA)).alias("p_bad"),
        )
    return last.select(F.col("g3").alias("gram"), (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", names=("host", "path", "rule", "verdict", "score")) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the models' score under ``names``.

    The verdict is the rule's; where none fits, "allow" if the score is at least the threshold, else "block".
    A null URL, or one without ``://``, has an empty host and path, fits no rule and is scored by its text. With no
    allowed or no blocked URL to learn from, all undecided ones are allowed. Equal URLs get equal verdicts. Columns
    of ``pages`` named like ``names`` are replaced, others pass through; an empty table gives an empty result.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() in {n.lower() for n in names} and c != url])
    host, path = host_path(F.col(url))
    text = normal(F.col(url))
    seen = pages.groupBy(text.alias("text"), rule_of(host, path, rules)["verdict"].alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    seen = materialise(seen, "urls")  # one row for each text of a URL and what the rules say
    held = F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") % HELD_OUT == 0

    def of(verdict: str) -> Column:
        return F.when((F.col("verdict") == verdict) & ~held, F.col("n")).otherwise(0)

    counted = (
        seen.select("text", of("allow").alias("good"), of("block").alias("bad"))
        .select(F.explode(grams(F.col("text"))).alias("gram"), "good", "bad")
        .groupBy("gram")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    ratios = materialise(model(materialise(counted, "url-grams")), "url-model")
    scores = (
        seen.select("text")
        .distinct()
        .select("text", F.explode(grams(F.col("text"))).alias("gram"))
        .join(F.broadcast(ratios), "gram")  # (len(ALPHABET) + 3) ** 4 rows at most
        .groupBy("text")
        .agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    )
    scores = materialise(scores, "url-scores")
    limit = threshold(seen.where(held & F.col("verdict").isNotNull()).join(scores, "text"))
    taught = seen.where(~held & F.col("verdict").isNotNull()).agg(F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")).first()
    if not taught[0] or not taught[1]:
        limit = float("-inf")
    t, s = fresh(pages, "text", "score")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in {n.lower() for n in names} or c == url]
    joined = pages.join(scores.toDF(t, s), text == F.col(t), "left")
    rule = rule_of(host, path, rules)
    by_score = F.when(F.col(s) >= F.lit(limit), "allow").otherwise("block") if limit > float("-inf") else F.lit("allow")
    return joined.select(
        *keep,
        host.alias(names[0]),
        path.alias(names[1]),
        rule["rule"].alias(names[2]),
        F.coalesce(rule["verdict"], by_score).alias(names[3]),
        F.col(s).alias(names[4]),
    )


def threshold(scored: DataFrame) -> float:
    """The score that best tells (verdict, n, score) apart: highest mean of the two rates of right verdicts.

    The scores are put in ``BINS`` equal steps of their range, and a window runs over the steps. Of equally good
    thresholds the middle is taken. With one verdict missing it is 0, where both models find a URL equally likely.
    """
    low, high, good, bad = scored.agg(
        F.min("score"), F.max("score"), F.sum(F.when(F.col("verdict") == "allow", F.col("n"))), F.sum(F.when(F.col("verdict") == "block", F.col("n")))
    ).first()
    if not good or not bad or high <= low:
        return 0.0
    step = (high - low) / BINS
    counts = scored.groupBy(F.floor((F.col("score") - low) / step).alias("bin")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("bad")
    )
    steps = scored.sparkSession.range(BINS + 1).select(F.col("id").alias("bin"))
    bins = steps.join(counts, "bin", "left").na.fill(0)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rates = bins.select(
        "bin", (1 - F.coalesce(F.sum("good").over(below), F.lit(0)) / good + F.coalesce(F.sum("bad").over(below), F.lit(0)) / bad).alias("both")
    )
    best = rates.groupBy(F.round("both", 9).alias("both")).agg(F.min("bin").alias("first"), F.max("bin").alias("last")).orderBy(F.desc("both")).first()
    return low + step * (best["first"] + best["last"]) / 2
