"""Product matching."""

from pyspark.sql import functions as F

from fillwise.operators import matching

from .views import products, rounded, sql, table

# Candidates disturb the identifiers and the text of every product, so that each tier decides for some.
_CANDIDATE = {
    "candidate_id": "p_partkey",
    "vendor_sku": "case when p_partkey % 4 = 0 then cast(p_partkey as string) else concat('X', cast(p_partkey as string)) end",
    "buyer_part_number": "case when p_partkey % 4 < 2 then concat('B', cast(p_partkey * 7 % 700 as string)) end",
    "upc": "case when p_partkey % 4 in (1, 2) then concat('U', cast(p_partkey * 3 % 900 as string)) end",
    "description": """case p_partkey % 5 when 0 then p_name when 1 then concat(p_name, ' ', lower(p_type))
        when 2 then concat(substring(p_name, 1, 4), ' ', substring(p_name, 6, 9)) when 3 then lower(p_type) else concat('brand ', p_name) end""",
}


def _candidates(spark, d):
    return table(spark, d, "part").selectExpr(*[f"{e} as {name}" for name, e in _CANDIDATE.items()])


def _targets(spark, d):
    return products(spark, d).withColumn("target_id", F.col("vendor_sku").cast("bigint"))


# A letter of every product's name left out, another one doubled, and both ends swapped in the fourth part of the names.
_MISSPELT = """case p_partkey % 4 when 0 then concat(substring(p_name, 1, cast(1 + p_partkey % 5 as int)), substring(p_name, cast(3 + p_partkey % 5 as int), 99))
    when 1 then concat(substring(p_name, 1, cast(2 + p_partkey % 4 as int)), substring(p_name, cast(2 + p_partkey % 4 as int), 99))
    when 2 then concat(substring(p_name, cast(1 + position(' ' in p_name) as int), 99), ' ', substring(p_name, 2, cast(position(' ' in p_name) - 2 as int)))
    else replace(p_name, ' ', '') end"""


def _misspelt(spark, d):
    """Candidates without identifiers, with names as they are typed."""
    return table(spark, d, "part").selectExpr(
        "p_partkey as candidate_id", *[f"cast(null as string) as {c}" for c in ("vendor_sku", "buyer_part_number", "upc")], f"{_MISSPELT} as description")


def _scores(spark, d):
    """Scores of all distinct pairs of a candidate text and a target text that share a word."""
    left = _candidates(spark, d).select(F.col("description").alias("a")).distinct()
    right = _targets(spark, d).select(F.col("description").alias("b")).distinct()
    word = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(F.trim(c), r"\s+"))).alias("word"))
    pairs = word(left, "a").join(word(right, "b"), "word").select("a", "b")
    return matching.similarity(pairs.distinct(), "a", "b")


# Descriptions of orders: thousands of distinct texts that share words with some others.
_ORDER = "concat(o_orderpriority, ' ', substring(cast(o_orderdate as string), 1, 7), ' c', cast(o_custkey as string), ' n', cast(o_orderkey % 50 as string))"
_ORDERS = "select distinct {text} as {name} from orders where o_orderkey % 2 = {side}"


def _similar(spark, d):
    """Descriptions of even orders against those of odd ones, by their common words."""
    orders = table(spark, d, "orders")
    side = lambda n, name: orders.filter(f"o_orderkey % 2 = {n}").selectExpr(f"{_ORDER} as {name}").distinct()
    return matching.word_scores(side(0, "a"), side(1, "b"), 90.0)


QUERIES = {
    "match_similar": lambda s, d: rounded(_similar(s, d), score=6),
    "match_exact": lambda s, d: matching.match_exact(_candidates(s, d), _targets(s, d)),
    "match_fuzzy": lambda s, d: rounded(_scores(s, d), score=6),
    "match_best": lambda s, d: rounded(matching.match_best(_candidates(s, d), _targets(s, d), 60.0), score=6),
    "match_misspelt": lambda s, d: rounded(matching.match_best(_misspelt(s, d), _targets(s, d)), score=6),
}

_CAND = f"select {', '.join(f'{e} as {n}' for n, e in _CANDIDATE.items())} from part"
_EXACT = dict(
    cand=_CAND,
    hits="""select candidate_id, cast(t.vendor_sku as bigint) as target_id,
        case when c.vendor_sku = t.vendor_sku then 100.0::double when c.buyer_part_number = t.buyer_part_number then 98 else 99 end as score
        from cand c join v_products t on c.vendor_sku = t.vendor_sku or c.buyer_part_number = t.buyer_part_number or c.upc = t.upc""",
    exact="""select candidate_id, target_id, score, case score when 100 then 'vendor_sku' when 99 then 'upc' else 'buyer_part_number' end as tier
        from hits qualify row_number() over (partition by candidate_id order by score desc, target_id) = 1""")
# Similarity of pairs(a, b): the longest common subsequence of the remaining words, one character of `ra` per step.
_SCORE = dict(
    sets="""select a, b, list_sort(list_distinct(string_split_regex(trim(a), '\\s+'))) as la,
        list_sort(list_distinct(string_split_regex(trim(b), '\\s+'))) as lb from pairs""",
    rests="""select a, b, list_sort(list_intersect(la, lb)) as c,
        array_to_string(list_filter(la, lambda x: not list_contains(lb, x)), ' ') as ra,
        array_to_string(list_filter(lb, lambda x: not list_contains(la, x)), ' ') as rb from sets""",
    keyed="select *, length(array_to_string(c, ' ')) as cl, length(ra) as al, length(rb) as bl from rests")
_STEPS = """steps(ra, rb, i, row) as (
      select distinct ra, rb, 0, list_transform(range(length(rb) + 1), lambda x: 0) from keyed where al > 0 and bl > 0
      union all
      select ra, rb, i + 1, list_transform(range(length(rb) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k:
        greatest(row[k + 1], case when k > 0 and substr(rb, k, 1) = substr(ra, i + 1, 1) then row[k] + 1 else 0 end))))
      from steps where i < length(ra)),
    lcs as (select ra, rb, list_last(row) as n from steps where i = length(ra)),
    scored as (select a, b, case when len(c) > 0 and (al = 0 or bl = 0) then 100.0::double else greatest(
        100.0 * (1 - (al + bl - 2 * coalesce(n, 0)) / (2.0::double * (cl + least(len(c), 1)) + al + bl)),
        case when len(c) > 0 then 200.0::double * cl / (2 * cl + 1 + al) else 0 end,
        case when len(c) > 0 then 200.0::double * cl / (2 * cl + 1 + bl) else 0 end) end as score
      from keyed left join lcs on keyed.ra = lcs.ra and keyed.rb = lcs.rb)"""


def _scored(pairs: str, body: str, **ctes: str) -> str:
    text = sql("", **ctes, pairs=pairs, **_SCORE)
    return text.replace("with ", "with recursive ", 1).rstrip() + f", {_STEPS} {body}"


ORACLE = {
    "match_similar": _scored(
        """select a, b from (select a, unnest(list_distinct(string_split_regex(trim(a), '\\s+'))) as w from lefts) x join
           (select b, unnest(list_distinct(string_split_regex(trim(b), '\\s+'))) as w from rights) y using (w)
           group by a, b having 200.0 * (sum(length(w)) + count(*) - 1) / (sum(length(w)) + count(*) - 1 + least(length(a), length(b))) >= 90""",
        "select a, b, round(score, 6) as score from scored",
        lefts=_ORDERS.format(text=_ORDER, name="a", side=0), rights=_ORDERS.format(text=_ORDER, name="b", side=1)),
    "match_exact": sql("select * from exact", **_EXACT),
    "match_fuzzy": _scored(
        """select distinct c.description as a, p.p_name as b from cand c join part p
           on list_has_any(string_split_regex(trim(c.description), '\\s+'), string_split_regex(trim(p.p_name), '\\s+'))""",
        "select a, b, round(score, 6) as score from scored", cand=_CAND),
    "match_best": _scored(
        """select r.description as a, p.description as b from (select distinct description from cand
           where candidate_id not in (select candidate_id from exact)) r cross join (select distinct description from v_products) p""",
        """, named as (select description as b, min(cast(vendor_sku as bigint)) as target_id from v_products group by 1),
           best as (select a, target_id, score from scored join named using (b) where score >= 60
             qualify row_number() over (partition by a order by score desc, target_id) = 1)
           select candidate_id, target_id, round(score, 6) as score, tier from exact
           union all select candidate_id, target_id, round(score, 6), 'description' from cand join best on description = a
           where candidate_id not in (select candidate_id from exact)""", **_EXACT),
    "match_misspelt": _scored(
        "select a.description as a, p.description as b from (select distinct description from cand) a cross join (select distinct description from v_products) p",
        """, named as (select description as b, min(cast(vendor_sku as bigint)) as target_id from v_products group by 1),
           best as (select a, target_id, score from scored join named using (b) where score >= 70
             qualify row_number() over (partition by a order by score desc, target_id) = 1)
           select candidate_id, target_id, round(score, 6) as score, 'description' as tier from cand join best on description = a""",
        cand=f"select p_partkey as candidate_id, {_MISSPELT} as description from part"),
}
