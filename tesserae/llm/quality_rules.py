"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

statistics() counts words, symbols, repeated lines and words of repeated word windows in each text. A rule
rejects a text whose statistic, a share, exceeds a cutoff. cutoffs() picks cutoffs per stratum from labelled rows in two folds.
The selection fold (a third, by a hash of the id) gives each rule its best cutoff (bad over good rejections, the loosest of equals)
and puts the useful rules in order. The other labelled rows certify: rule by rule in that order, all rules so far together must pass the
exact binomial test, P(Bin(n, risk) <= false rejections) <= level, until one fails (a fixed-sequence test, so the rules
share one risk and one level); the level is the error divided by the number of strata that have a useful rule (Bonferroni;
the selection fold alone says which). So with probability 1 - error all cutoffs together reject at most the share risk of good
texts in every stratum. Without a certified rule nothing more than the base rules rejects in a stratum: at the given values
no false rejection among 59 good rows of the certifying fold certifies one stratum alone, 86 certify one of four.
achieved() gives the rate on any labelled rows, such as ones held out.

Windows are compared by 64-bit hashes. Defined cases: a null text has no words, so all counts are 0 and it fails
the base rules; a null stratum is a stratum of its own; null labels and labels without a document don't count,
and a document with several labels counts once for each; repeated rows are kept row by row; empty tables give
empty results and no cutoffs. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import stored

#: Share of good texts that all rules together may reject, and the chance that the guarantee fails.
RISK, ERROR = 0.05, 0.05
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
MIN_WORDS, REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def repeated_words(rows: DataFrame, ws: str, name: str, k: int = 3) -> DataFrame:
    """rows with name: words that lie in a k-word window found twice or more, the first time included.

    Each step is a column of its own, because an expression inside a lambda is evaluated for every element.
    """
    at = F.when(F.size(ws) > k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(ws, i + j) for j in range(k)]).alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.array_sort(windows))
    # equal windows are neighbours now; each that equals the one before or after it is repeated
    h = lambda j: F.get("_sorted", j)["h"]
    again = F.filter("_sorted", lambda x, j: (h(j - 1) == x["h"]) | (h(j + 1) == x["h"]))
    rows = rows.withColumn("_again", again).withColumn("_place", F.array_sort(F.transform("_again", lambda x: x["i"])))
    # windows overlap: each covers the words up to the next repeated window, k at most
    covers = F.transform("_place", lambda p, j: F.least(F.lit(k), F.coalesce(F.get("_place", j + 1) - p, F.lit(k))))
    return rows.withColumn(name, F.aggregate(covers, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("_sorted", "_again", "_place")


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts, base_failed and the shares that the rules look at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = repeated_words(rows.select("doc_id", "stratum", "text", words(F.col("text")).alias("ws")), "ws", "n_repeat_words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "stratum", F.size("ws").cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        lines.alias("lines"), "n_repeat_words",
    )
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"))


def log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series where long integers don't reach."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), from the largest term down; 1 where k is over the mean, which can certify nothing.

    Terms more than 40 standard deviations below k are less than doubles hold and left out: their number is a root of n.
    """
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    last = F.greatest(F.lit(1), k - F.ceil(40 * F.sqrt(n * (p * (1 - p)))) - 50).cast("long")
    down = F.when(k > 0, F.sequence(k.cast("long"), last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.when((k > n * p) | (n <= 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * F.aggregate(down, start, step, lambda acc: acc["sum"])))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    return stats.join(good, "doc_id")


def cutoffs(stats: DataFrame, labels: DataFrame, rules: Sequence[str] = RULES, grid: Sequence[float] = GRID, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, step, n_good, false_rejections, bad_rejections) of certified rules; counts are of the certifying fold and of all rules so far."""
    selects = F.pmod(F.xxhash64(F.lit("selection"), "doc_id"), F.lit(3)) == 0
    rows = stored(labelled(stats, labels, id_col, label).select("stratum", "label", *rules, selects.alias("selects")), "rules")
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).alias("rejected")) for r in rules for c in grid]
    gain = F.sum(F.when(~F.col("t.rejected"), 0).when(F.col("label") == 0, 1).otherwise(-1))
    tried = rows.where("selects").select("stratum", "label", F.explode(F.array(*tests)).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(gain.alias("gain"))
    best = tried.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b")).where("b.gain > 0")
    order = F.struct((-F.col("b.gain")).alias("loss"), "rule", F.col("b.cutoff").alias("cutoff"))
    paths = stored(best.groupBy("stratum").agg(F.array_sort(F.collect_list(order)).alias("path")), "rules")  # a row for each stratum
    value = lambda r: F.coalesce(*[F.when(r == name, F.col(name)) for name in rules])
    met = F.array_position(F.transform("path", lambda x: value(x["rule"]) > x["cutoff"]), True)
    firsts = rows.where("not selects").join(paths, "stratum").select("stratum", "label", "path", met.alias("met"))
    among = lambda v, i: F.sum(F.when((F.col("label") == v) & F.col("met").between(1, i), 1).otherwise(0)).cast("long")
    sums = [F.struct(F.lit(i).alias("step"), among(1, i).alias("false_rejections"), among(0, i).alias("bad_rejections")) for i in range(1, len(rules) + 1)]
    counts = firsts.groupBy("stratum").agg(F.first("path").alias("path"), F.sum("label").cast("long").alias("n_good"), F.array(*sums).alias("sums"))
    level = error / max(1, paths.count())
    each = counts.select("stratum", "n_good", F.explode(F.arrays_zip("path", F.slice("sums", F.lit(1), F.size("path")).alias("sums"))).alias("x"))
    each = each.select("stratum", F.col("x.path.rule").alias("rule"), F.col("x.path.cutoff").alias("cutoff"), "n_good", "x.sums.*")
    tested = each.withColumn("certified", binomial_tail(F.col("n_good"), F.col("false_rejections"), risk) <= level)
    # the sequence stops at the first rule that isn't certified
    stop = tested.groupBy("stratum").agg(F.min(F.when(~F.col("certified"), F.col("step"))).alias("stop"))
    return tested.join(stop, "stratum").where("stop is null or step < stop").select("stratum", "rule", "cutoff", "step", "n_good", "false_rejections", "bad_rejections")


def achieved(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, n_good, false_rejections, n_bad, bad_rejections) by the rules with cutoffs, on labelled rows; judged is of verdicts()."""
    rows = labelled(judged, labels, id_col, label)
    count = lambda v, which=F.lit(True): F.sum(F.when((F.col("label") == v) & which, 1).otherwise(0)).cast("long")
    return rows.groupBy("stratum").agg(count(1).alias("n_good"), count(1, F.col("rule_rejected")).alias("false_rejections"), count(0).alias("n_bad"), count(0, F.col("rule_rejected")).alias("bad_rejections"))


def verdicts(stats: DataFrame, cuts: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """stats with rule_rejected, by a cutoff of the text's stratum, and kept: false where that or the base rules reject it."""
    by = cuts.groupBy("stratum").pivot("rule", list(rules)).agg(F.min("cutoff"))
    by = by.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in rules])
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in rules]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    judged = stats.join(by, "stratum", "left").withColumn("rule_rejected", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("rule_rejected"))


def rule_kept(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", stratum: str = "lang", **options) -> DataFrame:
    """Statistics and verdict of every row of docs."""
    stats = stored(statistics(docs, text, id_col, stratum), "rules")
    cuts = stored(cutoffs(stats, labels, id_col=id_col, **options), "rules")
    return verdicts(stats, cuts)
