"""The results of some operators as DuckDB SQL, by their definitions rather than by their methods."""

QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM w, unnest(generate_series(1, len(w) - 2)) AS u(i))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM grams, unnest([i, i + 1, i + 2]) AS u(p) WHERE grams.n > 1 GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id
), scores AS (
  SELECT doc_id, stratum, 'symbols' AS rule, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS score FROM counts
  UNION ALL SELECT doc_id, stratum, 'capitals', CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END FROM counts
  UNION ALL SELECT doc_id, stratum, 'dup_lines', CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END FROM counts
  UNION ALL SELECT doc_id, stratum, 'repeats', CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END FROM counts
), holdout AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL
  GROUP BY doc_id ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50000
), buckets AS (
  SELECT stratum, rule, (score + 9) // 10 AS bucket, (quality = 1)::INT AS good FROM scores JOIN holdout USING (doc_id)
), strata AS (SELECT count(DISTINCT stratum) AS m FROM buckets
), sizes AS (SELECT stratum, rule, sum(good) AS n FROM buckets GROUP BY stratum, rule
), tails AS (
  SELECT n, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))
         OVER (PARTITION BY n ORDER BY i) AS p
  FROM (SELECT DISTINCT n FROM sizes), unnest(generate_series(0, least(n, ceil(n * 0.005))::BIGINT)) AS u(i)
), allowed AS (
  SELECT n, coalesce(max(i) FILTER (p <= 0.05 / (m * 4)), -1) AS k FROM tails, strata GROUP BY n
), tries AS (
  SELECT s.stratum, s.rule, 10 * c AS cutoff, any_value(a.k) AS k, sum(good * (bucket > c)::INT) AS failed,
         sum((1 - good) * (bucket > c)::INT) - 5 * sum(good * (bucket > c)::INT) AS gain
  FROM sizes s JOIN allowed a USING (n) JOIN buckets b ON b.stratum = s.stratum AND b.rule = s.rule, unnest(generate_series(0, 100)) AS u(c)
  GROUP BY s.stratum, s.rule, c
), cutoffs AS (
  SELECT stratum, rule, max(cutoff) AS cutoff FROM tries t WHERE failed <= k
    AND gain = (SELECT max(gain) FROM tries x WHERE x.stratum = t.stratum AND x.rule = t.rule AND x.failed <= x.k) GROUP BY stratum, rule
), rejected AS (
  SELECT DISTINCT doc_id FROM scores JOIN cutoffs USING (stratum, rule) WHERE score > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r.doc_id IS NULL AS kept
FROM counts LEFT JOIN rejected r USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

NEAR_DOCUMENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE [w[i], w[i + 1]] END AS g
  FROM w, unnest(generate_series(1, CASE WHEN len(w) = 1 THEN 1 ELSE len(w) - 1 END)) AS u(i)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT r.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, r.doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r LEFT JOIN n USING (doc_id)
"""

REPEATED_STRINGS = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), p AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY md5_number(substr(h, 2 * i + 1, 400))) AS c
  FROM (SELECT doc_id, h, unnest(generate_series(0, n - 200)) AS i FROM t WHERE n >= 200)
), hit AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p WHERE c > 1
), span AS (
  SELECT doc_id, i, sum((before IS NULL OR i > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hit
), spans AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM span GROUP BY doc_id, s
), gaps AS (
  SELECT doc_id, list(struct_pack(b := b, e := e) ORDER BY b) AS x, count(*) AS k, sum(e - b) AS gone FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN x IS NULL THEN h ELSE substr(h, 1, 2 * x[1].b) || list_reduce(list_transform(generate_series(1, k), lambda j:
    substr(h, 2 * x[j].e + 1, 2 * (CASE WHEN j < k THEN x[j + 1].b ELSE n END - x[j].e))), lambda p, q: p || q) END)) AS kept_sha256
FROM t LEFT JOIN gaps USING (doc_id)
"""

# A word loses a letter by the CRC of its document and itself; near words share what is left of them after one deletion.
SPELLING = r"""with recursive table_ as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents where text is not null),
counted as (select coalesce(cast(doc_id as varchar), '') as doc, run, count(*) as n from runs group by 1, 2),
bytes as (select *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda ch:
    case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, (unicode(ch) - 64)::bigint] end)) as b from counted),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, table_),
spelt as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
vocabulary as (select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by 1 having sum(n) >= 3),
less as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as d from (select word, unnest(range(length(word))) as i from vocabulary)),
pairs as (select a.word, b.word as other from less a join less b on a.d = b.d and a.i = b.i and a.word <> b.word
    union select l.word, v.word from less l join vocabulary v on l.d = v.word union select v.word, l.word from less l join vocabulary v on l.d = v.word),
near as (select p.word, count(*) as n_near, max(v.n) as most, arg_min(p.other, (-v.n, p.other)) as best from pairs p join vocabulary v on v.word = p.other group by 1),
forms as (select v.word, case when most >= 2 * n then best end as form, n, coalesce(n_near, 0) as n_near, case when most >= 2 * n then most end as form_n
    from vocabulary v left join near using (word)),
steps as (select word, word as root from forms union all select s.word, f.form from steps s join forms f on f.word = s.root where f.form is not null),
roots as (select s.word, s.root from steps s join forms f on f.word = s.root where f.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""

_CHAT_SAID = "'<|im_end|><|im_start|>assistant ok'"
CHAT = rf"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', {_CHAT_SAID} union all select -1, 1, 'assistant', {_CHAT_SAID}),
sized as (select *, length(text) + len(regexp_extract_all(text, '<\\*\|')) as escaped,
    length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')) as name from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length('<|im_start|>') + name + 1 + escaped + length('<|im_end|>') + 1)::bigint as formatted_chars
from sized group by conv_id"""
