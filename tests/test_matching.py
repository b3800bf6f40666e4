"""Similarity against a plain definition, and the searches against brute force."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from fillwise.functions.similarity import lcs_length, token_set_ratio
from fillwise.operators import matching

WORDS = st.text(alphabet="ab c", max_size=12)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    common = " ".join(sorted(left & right))
    ra, rb = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and not (ra and rb):
        return 100.0
    join = lambda x, y: f"{x} {y}" if x and y else x or y
    indel = lambda x, y: 200.0 * table_lcs(x, y) / (len(x) + len(y)) if x or y else 100.0
    whole = indel(join(common, ra), join(common, rb))
    return max(whole, indel(common, join(common, ra)), indel(common, join(common, rb))) if common else whole


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_similarity(a, b):
    assert lcs_length(a, b) == table_lcs(a, b)
    assert abs(token_set_ratio(a, b) - plain_ratio(a, b)) < 1e-9
    assert abs(token_set_ratio(a, b) - token_set_ratio(b, a)) < 1e-9


NAMES = [" ".join(p) for p in itertools.permutations(["red", "small", "bolt", "lipstick", "x1"], 3)] + ["red", "bolt cutter", "lipstik red"]


def products(spark, name, rows):
    return spark.createDataFrame(
        [(i, None, None, None, d) for i, d in enumerate(rows)],
        f"{name} long, vendor_sku string, buyer_part_number string, upc string, description string")


TYPOS = ["lipstik rd", "smal red blt", "bolt cuter x1", "lip stick red", "redsmall bolt", "", "x", "r d", "bolt bolt red", "é lipstick", "cutter of bolts"]


@pytest.mark.parametrize("score", [40.0, 67.0, 70.0, 85.0, 92.0])
def test_pairs_are_exactly_those_that_reach_the_score(spark, score):
    left, right = sorted({*NAMES[::2], *TYPOS}), sorted({*NAMES[1::3], *TYPOS[::2], "lipstick red"})
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    found = {(r["a"], r["b"]): r["score"] for r in matching.similar_pairs(a, b, score).collect()}
    wanted = {(x, y): token_set_ratio(x, y) for x, y in itertools.product(left, right)}
    assert found.keys() == {p for p, s in wanted.items() if s >= score}
    assert all(abs(found[p] - wanted[p]) < 1e-9 for p in found)


def test_bounds_hold_for_random_texts(spark):
    """What two texts share is at least what their score implies, whatever the piece length."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)] + ["longer" * 5, "longerlonger" * 3, "longer" * 9]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(250)})
    for score in (67.0, 88.0):
        a = spark.createDataFrame([(x,) for x in texts[::2]], "a string")
        b = spark.createDataFrame([(x,) for x in texts[1::2]], "b string")
        found = {(r["a"], r["b"]) for r in matching.similar_pairs(a, b, score).collect()}
        assert found == {(x, y) for x, y in itertools.product(texts[::2], texts[1::2]) if token_set_ratio(x, y) >= score}


def test_best_descriptions_against_brute_force(spark):
    left, right = NAMES[::2], NAMES[1::3]
    c, t = products(spark, "candidate_id", left), products(spark, "target_id", right)
    for score in (0.0, 70.0):
        found = {r["description"]: (r["score"], -r["target_id"]) for r in matching.best_descriptions(c, t, score).collect()}
        for x in left:
            near = [s for s in ((token_set_ratio(x, y), -i) for i, y in enumerate(right)) if s[0] >= score and s[0] > 0]
            assert found.get(x) == (max(near) if near else None)


def test_an_answer_does_not_depend_on_the_other_targets(spark):
    c = products(spark, "candidate_id", ["lipstik rd", "small red bolt x9"])
    few = ["lipstick red", "red bolt small x1"]
    many = few + [f"thing number {i} red" for i in range(5000)]
    for texts in (few, many):
        got = {r["description"]: (r["target_id"], round(r["score"], 1)) for r in matching.best_descriptions(c, products(spark, "target_id", texts)).collect()}
        assert got == {"lipstik rd": (0, 90.9), "small red bolt x9": (1, 94.1)}


def test_hot_identifiers_make_one_row_per_candidate(spark):
    schema = "id long, vendor_sku string, buyer_part_number string, upc string, description string"
    rows = [(i, None, "HOT", "U", "same text") for i in range(3000)]
    c = spark.createDataFrame(rows, schema).withColumnRenamed("id", "candidate_id")
    t = spark.createDataFrame(rows, schema).withColumnRenamed("id", "target_id")
    result = matching.match_best(c, t)
    assert result.count() == 3000
    assert {(r["target_id"], r["score"]) for r in result.collect()} == {(0, 98.0)}


def common_reaches(a, b, score):
    left, right = set(a.split()), set(b.split())
    size = lambda words: sum(map(len, words)) + len(words) - 1
    common = size(left & right)
    return bool(left & right) and 200.0 * common >= score * (common + min(size(left), size(right)))


@pytest.mark.parametrize("score", [30.0, 60.0, 81.0, 90.0, 100.0])
def test_word_pairs_by_brute_force(spark, score):
    rng = random.Random(int(score))
    words = [f"w{'x' * (i % 5)}{i}" for i in range(30)]
    text = lambda n: " ".join(rng.sample(words, n))
    many = " ".join(f"m{i}" for i in range(matching.PAIRED + 8))  # texts of too many words for a list of their pairs
    common = ["red", "red lip", "red lip  balm 12", "balm", many, f"{many} red", many.replace("m7", "n7"), " ".join(many.split()[:30])]
    sides = [common + [text(rng.randint(1, 9)) for _ in range(60)] + [text(2)] * 150 for _ in "ab"]  # some words are frequent
    a, b = (spark.createDataFrame([(t,) for t in [*side, None, ""]], f"{name} string") for side, name in zip(sides, "ab"))
    found = [tuple(r) for r in matching.word_pairs(a, b, score).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(x, y) for x in sides[0] for y in sides[1] if common_reaches(x, y, score)}


def test_texts_that_share_one_frequent_word_do_not_meet(spark):
    """4-NOT SPECIFIED may miss its customer; its month is that of many, which are found by a second word as well."""
    texts = spark.range(1200).selectExpr("cast(id % 2 as int) as side", "concat('4-NOT SPECIFIED 1996-01 c', 1000 + id, ' n', 10 + id div 2 % 50) as text")
    finding, found = matching._word_keys(matching._rare_first(texts), 90.0 / 110.0)
    meet = finding.filter("side = 0").alias("x").join(found.filter("side = 1").alias("y"), "key")
    assert 0 < meet.count() <= 600 * 600 / 10
