"""Quality rules whose cutoffs are certified on labelled documents. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fillwise.llm.common import SPACE, WORD, let, stored

#: Each rule's score counts these of a document in thousandths of those; higher is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs are tried in steps of so many thousandths.
STEP = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more; the first finding counts too."""

    def covered(grams: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda p, k: F.coalesce(p["g"] == F.get(pairs, k - 1)["g"], F.lit(False))
                             | F.coalesce(p["g"] == F.get(pairs, k + 1)["g"], F.lit(False)))
            places = F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
            return F.size(F.array_distinct(places))

        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(pairs, of_sorted))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(grams, covered))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct `counts` with COUNTS of each whole text (null: no words). Windows are compared by 64-bit hashes."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    parts = docs.withColumn("counts", F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).alias("n_symbols"), F.regexp_count(whole, F.lit("[A-Z]")).alias("n_capitals")))
    c = F.col("counts")
    place = {"n_words": c["w"]["n_words"], "word_chars": c["w"]["word_chars"], "n_repeat_words": c["w"]["n_repeat_words"],
             "n_lines": c["l"]["n_lines"], "n_dup_lines": c["l"]["n_dup_lines"], "n_symbols": c["n_symbols"], "n_capitals": c["n_capitals"]}
    return parts.withColumn("counts", F.struct(*[place[k].cast("long").alias(k) for k in COUNTS]))


def base_failed() -> Column:
    c = F.col("counts")
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def score(rule: str) -> Column:
    """A rule's score in whole thousandths, 0 for a document without the whole."""
    part, whole = (F.col("counts")[k] for k in RULES[rule])
    return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(F.lit(0)).cast("long")


def allowed_failures(n: Column, limit: float, level: Column) -> Column:
    """The most failures k among n for which the exact binomial bound holds: P(Bin(n, limit) <= k) <= level.

    Then the Clopper-Pearson upper bound of the failure rate at confidence 1 - level is at most
    `limit`. -1 if even no failure proves it.
    """
    odds = math.log(limit / (1 - limit))
    start = F.struct((n * math.log(1 - limit)).cast("double").alias("log_p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        total = a["sum"] + F.exp(a["log_p"])
        further = a["log_p"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + odds
        return F.struct(F.when(i < n, further).otherwise(a["log_p"]).alias("log_p"), total.alias("sum"),
                        F.when(total <= level, i.cast("long")).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * limit)), start, step)["k"]


def certified_cutoffs(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", limit: float = 0.02,
                      error: float = 0.05, weight: int = 5) -> DataFrame:
    """stratum, rule and the cutoff in thousandths above which a document is rejected.

    With probability 1 - `error` the rules together reject at most a share `limit` of the good
    documents of every stratum. The rules share the limit evenly. Each test is an exact binomial
    bound on the good holdout documents of its stratum; the error is divided by strata times rules
    (Bonferroni), and a rule's cutoffs are tested in a fixed sequence from lenient to strict until
    one fails. Of the certified cutoffs a rule takes the one with most rejected bad less `weight`
    times rejected good holdout documents, the most lenient of equals; with none certified it is off.

    The holdout are all labelled documents. One with contradicting labels counts as bad. Null labels
    and ids are left out; a null stratum is the stratum ''. Texts are counted where they lie, once,
    and only their counts meet the labels.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    held = with_counts(texts.filter("doc_id is not null")).drop("text").join(rows, "doc_id")
    good = (F.col("quality") == 1).cast("long")
    each = held.select("stratum", good.alias("good"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.ceil(score(r) / STEP).alias("bucket")) for r in RULES])).alias("x"))
    found = each.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket")).agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    found = stored(found, "buckets")  # a row per stratum, rule and bucket, read twice
    # A document fails cutoff c * STEP exactly if its bucket is above c.
    spread = found.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("bucket", "good", "bad")).alias("buckets"))
    strata = spread.agg(F.count_distinct("stratum").alias("strata"))
    each_limit, rules = limit / len(RULES), len(RULES)
    tested = spread.crossJoin(F.broadcast(strata)).withColumn(  # one row
        "k", allowed_failures(F.col("n"), each_limit, error / (F.col("strata") * rules)))

    def above(name: str, c: Column) -> Column:
        return F.aggregate(F.col("buckets"), F.lit(0).cast("long"), lambda a, b: a + F.when(b["bucket"] > c, b[name]).otherwise(0))

    tries = F.transform(F.sequence(F.lit(0), F.lit(1000 // STEP)), lambda c: F.struct(
        above("good", c).alias("failed"), (above("bad", c) - weight * above("good", c)).alias("gain"), (c * STEP).cast("long").alias("cutoff")))
    certified = F.filter(tries, lambda t: t["failed"] <= F.col("k"))
    best = F.array_max(F.transform(certified, lambda t: F.struct(t["gain"], t["cutoff"])))
    return tested.select("stratum", "rule", best["cutoff"].alias("cutoff")).filter("cutoff is not null")


def rated(docs: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Adds `counts`, `base_failed` and `kept` to every row of docs; columns of these names are replaced.

    A row is kept if it passes the base and no rule of its stratum puts it above a cutoff.
    """
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cutoffs"))
    rows = with_counts(docs.drop("counts", "base_failed", "kept"))
    rows = rows.join(by_stratum, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__stratum"), "left")
    over = [F.coalesce(score(r) > F.col("__cutoffs")[r], F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return rows.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | rejected)}).drop("__stratum", "__cutoffs")
