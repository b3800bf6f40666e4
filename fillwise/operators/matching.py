"""Product matching: exact identifiers first, then similar descriptions.

Candidates (`candidate_id`) and targets (`target_id`) both carry `vendor_sku`, `buyer_part_number`,
`upc` and `description`. A candidate gets at most one target, so groups of equal targets are reduced to
their smallest id before any join: joins are many-to-one and no list of pairs is built.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import blank_to_null
from ..functions.similarity import description_score, pairs_by_letters
from ..session import held

# Score of each identifier, and the name of its tier.
SKU_SCORE, UPC_SCORE, BUYER_SCORE = 100.0, 99.0, 98.0

# Default of `min_score`: the score that a pair of descriptions must reach.
MIN_SCORE = 70.0
# From this score on, pairs are found through shared pieces of words; below, no piece need be shared.
LEAST_FILTERED = 200.0 / 3
# Characters of a piece of a word.
PIECE = 2
# Keys are made of three pieces for texts of at most so many characters that must be much alike, else of two.
THREE_FROM, THREE_LENGTH = 85.0, 48
# Words of more texts than FREQUENT come last in the order of words; texts of more than PAIRED words have no list of pairs of them.
FREQUENT, PAIRED = 100, 32
# Descriptions compared at a time below LEAST_FILTERED.
BLOCK = 1000


def _clean(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(id_column, *[blank_to_null(F.col(c)).alias(c) for c in
                                  ("vendor_sku", "buyer_part_number", "upc", "description")])


def match_exact(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Best exact target per candidate: (candidate_id, target_id, score, tier); smallest id on a tie.

    SKU 100, UPC 99, buyer part 98. A pair that shares buyer part and UPC counts as a buyer-part match,
    so the UPC tier needs the smallest target with another buyer part; two entries per UPC are enough
    to find it.
    """
    c, t = _clean(candidates, "candidate_id"), _clean(targets, "target_id")
    by = lambda key: (t.filter(F.col(key).isNotNull()).groupBy(key)
                      .agg(F.min("target_id").alias(f"{key}_target")))
    per_upc_buyer = (t.filter(F.col("upc").isNotNull()).groupBy("upc", "buyer_part_number")
                     .agg(F.min("target_id").alias("target_id")))
    place = Window.partitionBy("upc").orderBy("target_id")
    two = per_upc_buyer.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= 2)
    at = lambda n, column: F.max(F.when(F.col("place") == n, F.col(column)))
    by_upc = two.groupBy("upc").agg(
        at(1, "target_id").alias("upc_first"), at(2, "target_id").alias("upc_second"),
        at(1, "buyer_part_number").alias("upc_first_buyer"))
    # Candidates without an identifier stay out of its join, so that blanks don't meet in one task.
    joined = c
    for key, side in (("vendor_sku", by("vendor_sku")), ("upc", by_upc), ("buyer_part_number", by("buyer_part_number"))):
        has, rest = joined.filter(F.col(key).isNotNull()), joined.filter(F.col(key).isNull())
        joined = has.join(side, key, "left").unionByName(rest, allowMissingColumns=True)
    same_buyer = F.coalesce(F.col("upc_first_buyer") == F.col("buyer_part_number"), F.lit(False))
    tiers = [
        (F.col("vendor_sku_target"), SKU_SCORE, "vendor_sku"),
        (F.when(same_buyer, F.col("upc_second")).otherwise(F.col("upc_first")), UPC_SCORE, "upc"),
        (F.col("buyer_part_number_target"), BUYER_SCORE, "buyer_part_number"),
    ]
    best = F.coalesce(*[
        F.when(target.isNotNull(), F.struct(target.alias("target_id"), F.lit(score).alias("score"), F.lit(tier).alias("tier")))
        for target, score, tier in tiers])
    return joined.withColumn("best", best).filter(F.col("best").isNotNull()).select("candidate_id", "best.*")


def _descriptions(df: DataFrame) -> DataFrame:
    return df.select(blank_to_null(F.col("description")).alias("description")).filter(F.col("description").isNotNull())


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `score` (0 to 100) to pairs of descriptions; equal pairs are scored once."""
    scored = pairs.select(a, b).distinct().withColumn("score", description_score(F.col(a), F.col(b)))
    return pairs.join(scored, [a, b])


def _rare_first(texts: DataFrame) -> DataFrame:
    """side, text and `tokens` of every text: its distinct words with their weights (length and a blank), rare ones first.

    The texts of both sides that have a word are counted, up to FREQUENT as none. So `tokens` are in one order for all
    texts, and only the frequent words, few of all, are joined to find it.
    """
    bag = texts.select("side", "text", F.explode(_words(F.col("text"))).alias("token"))
    frequent = bag.groupBy("token").agg(F.count("*").alias("uses")).filter(F.col("uses") > FREQUENT)
    word = F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token", (F.length("token") + 1).alias("weight"))
    return bag.join(frequent, "token", "left").groupBy("side", "text").agg(
        F.sort_array(F.collect_set(word)).alias("tokens"))  # one text's words


def _word_keys(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """side, text and key: keys by which a text finds all others that hold `share` of it, and keys by which it is found.

    Of the words that two texts share take the first two. If the first is missed, or the second, what follows must still
    make up the share; that leaves few words at the front. A word that makes up the share alone is a key, other words are
    keys in pairs. Texts of more than PAIRED words are found by each of them, not by pairs.
    """
    weight = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + w["weight"])
    alone = lambda w: F.xxhash64(w["token"])
    crowd = lambda w: F.xxhash64(w["token"], F.lit("of many"))
    pair = lambda v, w: F.xxhash64(v["token"], w["token"])
    after = lambda i: F.slice("tokens", i + 2, F.size("tokens"))

    rows = rows.withColumn("needed", share * (weight(F.col("tokens")) - 1) + 1 - 1e-6)
    rows = rows.withColumn("tokens", F.transform("tokens", lambda w, i: F.struct(
        w["token"].alias("token"), w["weight"].alias("weight"),
        weight(F.slice("tokens", i + 1, F.size("tokens"))).alias("left"))))  # what this word and those after it weigh
    seconds = lambda v, i: F.filter(after(i), lambda w: v["weight"] + w["left"] >= F.col("needed"))
    of_word = lambda v, i: (F.when(v["left"] < F.col("needed"), F.array().cast("array<bigint>"))
                            .when(v["weight"] >= F.col("needed"), F.array(alone(v)))
                            .otherwise(F.concat(F.array(crowd(v)), F.transform(seconds(v, i), lambda w: pair(v, w)))))
    finding = F.flatten(F.transform("tokens", of_word))
    pairs = F.flatten(F.transform("tokens", lambda v, i: F.transform(after(i), lambda w: pair(v, w))))
    found = F.concat(F.transform("tokens", alone), F.when(F.size("tokens") > PAIRED, F.transform("tokens", crowd)).otherwise(pairs))
    keys = lambda of: rows.select("side", "text", F.explode(of).alias("key"))
    return keys(finding), keys(found)


def word_pairs(left: DataFrame, right: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Distinct (a, b) whose common words alone reach `min_score`.

    The score of common words c against a whole description a is 200 |c| / (|c| + |a|), so c must make
    up min_score / (200 - min_score) of a or of b. That description finds the other by a key of `_word_keys`,
    and pairs are judged where they meet, before any of them is shuffled.
    """
    texts = left.select(F.lit(0).alias("side"), F.col("a").alias("text")).unionByName(right.select(F.lit(1).alias("side"), F.col("b").alias("text")))
    finding, found = _word_keys(held(_rare_first(texts), "words"), min_score / (200.0 - min_score))
    side = lambda df, n: df.filter(F.col("side") == n).select("key", F.col("text").alias("ab"[n]))

    def good(pairs: DataFrame) -> DataFrame:
        size = lambda words: F.length(F.array_join(words, " "))
        pairs = pairs.withColumns({"a_words": _words(F.col("a")), "b_words": _words(F.col("b"))})
        common = size(F.array_intersect("a_words", "b_words"))
        reached = 200.0 * common >= min_score * (common + F.least(size(F.col("a_words")), size(F.col("b_words"))))
        return pairs.filter(reached & (common > 0)).select("a", "b")

    return good(side(finding, 0).join(side(found, 1), "key")).unionByName(good(side(found, 0).join(side(finding, 1), "key"))).distinct()


def word_scores(left: DataFrame, right: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """`word_pairs` with their `score`, which is at least that of their common words."""
    return word_pairs(left, right, min_score).withColumn("score", description_score(F.col("a"), F.col("b")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.trim(text), r"\s+"))


def _pieces(text: Column) -> Column:
    """All pieces of PIECE characters of the words of a text, a blank before and behind each word; of equal pieces each has its number."""
    padded = F.transform(_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - PIECE + 1), lambda i: F.substring(w, i, PIECE))
    every = F.flatten(F.transform(padded, of_word))
    one = lambda pieces: F.transform(pieces, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda x: x == p)).cast("string")))
    return F.element_at(F.transform(F.array(every), one), 1)


def least_shared(pieces: Column, length: Column, other: Column | None, min_score: float) -> Column:
    """How many pieces a description shares at least with one that scores `min_score` by the first comparison.

    The two have at most d = (1 - score) (length + other) characters of their own, some here and some there. One here is in
    PIECE pieces, one there comes between PIECE - 1. With `other` unknown the shortest possible one is the worst.
    """
    score = min_score / 100.0
    if other is None:
        other = length * (score / (2.0 - score))
    own = ((1.0 - score) * (length + other) + length - other) / 2
    theirs = ((1.0 - score) * (length + other) + other - length) / 2
    return F.ceil(pieces - PIECE * own - (PIECE - 1) * theirs - 1e-6).cast("int")


def _keys(rows: DataFrame, min_score: float) -> DataFrame:
    """side, id and key: descriptions of both sides that share the pieces they must have a key in common.

    Pieces are put in one order, the rarest first. Of two descriptions that share n pieces, all but the last n - k
    pieces of each hold k shared ones. So a key is made of k pieces, as many as both must share, up to two, or three for
    short texts. Texts that must share more have keys of fewer pieces only for partners that need not: tags keep them apart.
    """
    each = rows.select("side", "id", "least", "length", F.explode("pieces").alias("piece"))
    uses = each.groupBy("piece").agg(F.count("*").alias("uses"))
    rows = held(each.join(uses, "piece").groupBy("side", "id", "least", "length").agg(
        F.sort_array(F.collect_list(F.struct("uses", "piece")))["piece"].alias("p")), "ordered")  # one text's pieces
    first = lambda k: F.slice("p", F.lit(1), F.size("p") - F.col("least") + k)
    after = lambda p, i: F.slice(p, i + 2, F.size(p))
    one = F.transform(first(1), lambda x: F.xxhash64(x))
    two = F.flatten(F.transform(first(2), lambda x, i: F.transform(after(first(2), i), lambda y: F.xxhash64(x, y))))
    three = F.flatten(F.flatten(F.transform(first(3), lambda x, i: F.transform(
        after(first(3), i), lambda y, j: F.transform(F.slice(first(3), i + j + 3, F.size("p")), lambda z: F.xxhash64(x, y, z))))))
    three_too = min_score >= THREE_FROM
    parts = []

    def add(level: int, keys: Column, tags: Column, some: Column | None = None) -> None:
        has = F.col("least") >= level if some is None else (F.col("least") >= level) & some
        parts.append(rows.filter(has).select("side", "id", F.explode(tags).alias("tag"), keys.alias("keys"))
                     .select("side", "id", F.explode("keys").alias("key"), F.lit(level).alias("level"), "tag"))

    def for_least(level: int) -> Column:
        """Tags for pairs of which one must share just `level` pieces: it meets all texts, those meet it alone."""
        left = F.col("side") == 0
        more = F.when(left, F.array(F.lit("left more"))).otherwise(F.array(F.lit("right more")))
        own = F.when(left, F.array(F.lit("equal"), F.lit("right more"))).otherwise(F.array(F.lit("equal"), F.lit("left more")))
        return F.when(F.col("least") == level, own).otherwise(more)

    every_one = F.array(F.lit("all"))
    add(1, one, for_least(1))
    if three_too:
        add(2, two, for_least(2))
        # A partner of a text of more than THREE_LENGTH characters is not much shorter.
        add(2, two, every_one, F.col("length") > THREE_LENGTH * (min_score / (200.0 - min_score)))
        add(3, three, every_one, F.col("length") <= THREE_LENGTH)
    else:
        add(2, two, every_one)
    every = reduce(lambda x, y: x.unionByName(y), parts)
    return every.select("side", "id", F.xxhash64("key", "level", "tag").alias("key"))


def _piece_candidates(left: DataFrame, right: DataFrame, min_score: float) -> DataFrame:
    """(a, b) whose words share as many pieces as the first comparison takes to reach `min_score`."""
    texts = left.select(F.lit(0).alias("side"), F.col("a").alias("text")).unionByName(right.select(F.lit(1).alias("side"), F.col("b").alias("text")))
    rows = texts.select("side", F.xxhash64("text").alias("id"), "text", _pieces(F.col("text")).alias("pieces"),
                        F.length(F.array_join(_words(F.col("text")), " ")).alias("length"))
    rows = held(rows.withColumn("least", least_shared(F.size("pieces"), F.col("length"), None, min_score)), "pieces")
    keys = _keys(rows, min_score)
    side = lambda df, n: df.filter(F.col("side") == n).drop("side")
    pairs = side(keys, 0).withColumnRenamed("id", "ia").join(
        side(keys, 1).withColumnRenamed("id", "ib").hint("merge"), "key").select("ia", "ib").distinct()  # far more keys than a planner expects
    named = lambda n, x: side(rows, n).select(F.col("id").alias(f"i{x}"), F.col("text").alias(x), F.col("pieces").alias(f"p{x}"), F.col("length").alias(f"l{x}"))
    full = pairs.join(named(0, "a"), "ia").join(named(1, "b"), "ib")
    shared = F.size(F.array_intersect("pa", "pb"))
    return full.filter(shared >= least_shared(F.size("pa"), F.col("la"), F.col("lb"), min_score)).select("a", "b")


def _block_candidates(left: DataFrame, right: DataFrame, min_score: float) -> DataFrame:
    """(a, b) by comparing blocks of descriptions with blocks: every pair whose letters allow the score.

    Below LEAST_FILTERED two descriptions may score without sharing a piece, so every one is compared with
    every other. A task holds two blocks; what it gives is what remains of their pairs.
    """
    def blocked(texts: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = texts.count()
        blocks = max(1, -(-n // BLOCK))
        rows = texts.withColumn(f"{name}_block", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))
        return rows.groupBy(f"{name}_block").agg(F.collect_list(name).alias(f"{name}s")), blocks  # about BLOCK texts

    (rows_a, _), (rows_b, blocks) = blocked(left, "a"), blocked(right, "b")
    rows = rows_a.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(rows_b, "b_block").select("as", "bs")
    return rows.mapInArrow(lambda batches: pairs_by_letters(batches, min_score), "a string, b string")


def similar_pairs(left: DataFrame, right: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """All distinct pairs of descriptions (columns `a`, `b`, of distinct texts) that score `min_score` or more, with `score`.

    A pair scores by its common words alone, or by all its characters: candidates for the first share a rare word,
    for the second they share pieces of words. Both filters are complete, so what is found does not depend on
    the other descriptions. Below LEAST_FILTERED all are compared in blocks, which takes the product of the two numbers.
    """
    left, right = (held(x.filter(F.trim(c) != ""), "texts") for x, c in ((left, "a"), (right, "b")))
    others = _piece_candidates(left, right, min_score) if min_score >= LEAST_FILTERED else _block_candidates(left, right, min_score)
    found = word_pairs(left, right, min_score).unionByName(others).distinct() if min_score > 0 else others
    return found.withColumn("score", description_score(F.col("a"), F.col("b"))).filter((F.col("score") >= min_score) & (F.col("score") > 0))


def best_descriptions(candidates: DataFrame, targets: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Best target per distinct candidate description: (description, target_id, score); smallest id on a tie.

    Distinct descriptions are compared, never rows; those without a target that scores `min_score` are left out.
    """
    wanted = _descriptions(candidates).distinct().withColumnRenamed("description", "a")
    named = held(_clean(targets, "target_id").filter(F.col("description").isNotNull())
                 .groupBy(F.col("description").alias("b")).agg(F.min("target_id").alias("target_id")), "named")
    pairs = similar_pairs(wanted, named.select("b"), min_score).join(named, "b")
    return pairs.groupBy(F.col("a").alias("description")).agg(
        F.max_by(F.struct("target_id", "score"), F.struct("score", -F.col("target_id"))).alias("best")
    ).select("description", "best.*")


def match_best(candidates: DataFrame, targets: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One target per candidate: the exact tiers decide, descriptions are compared for the rest.

    Candidates without any match are left out.
    """
    exact = match_exact(candidates, targets)
    exact = held(exact, "exact")
    rest = held(_clean(candidates, "candidate_id").join(exact, "candidate_id", "left_anti"), "rest")
    fuzzy = rest.join(best_descriptions(rest, targets, min_score), "description").select(
        "candidate_id", "target_id", "score", F.lit("description").alias("tier"))
    return exact.unionByName(fuzzy)
