"""SQL that gives the rows of the training-data queries by plain joins and aggregates."""

NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
STEM = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(.|\n)*[/\\]', ''), '\.(txt|png|pdf)$', '')"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
SPLIT = "CASE WHEN lower(trim(split_name)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split_name)) IN ('val', 'valid', 'validation', 'dev') THEN 'validation' WHEN lower(trim(split_name)) IN ('test', 'testing') THEN 'test' END"

TERMS = f"SELECT text_name, {NORM.format('k')} AS term FROM (SELECT text_name, unnest(keywords) AS k FROM data_text_keywords) WHERE k IS NOT NULL"
P1_FREQUENCIES = f"""
SELECT term, count(*) AS occurrences, count(DISTINCT text_name) AS texts,
  CASE WHEN count(DISTINCT text_name) < 3 THEN 'rare' WHEN count(DISTINCT text_name) * 100 >= 5 * (SELECT count(DISTINCT text_name) FROM data_text_keywords) THEN 'common' END AS band
FROM ({TERMS}) WHERE term <> '' GROUP BY term
"""
P1_FOUND = f"SELECT term, band FROM ({P1_FREQUENCIES}) WHERE band IS NOT NULL"
P1_WORD_GRAMS = f"""
WITH w AS (SELECT text_name, {WORDS.format('k')} AS ws FROM (SELECT text_name, unnest(keywords) AS k FROM data_text_keywords) WHERE k IS NOT NULL),
g AS (SELECT text_name, n::INTEGER AS n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT text_name, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS n FROM w)))
SELECT gram, n, count(*) AS occurrences, count(DISTINCT text_name) AS texts FROM g GROUP BY gram, n
"""


def _groups(links: str) -> str:
    """Groups of two or more records from a query of links (a, b) in both directions."""
    return f"""
WITH RECURSIVE links AS ({links}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT least(min(b), a) AS group_id, a AS query_id FROM reach WHERE a <> b GROUP BY a
"""


OVERLAP = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
SETS = f"SELECT query_id, {SPLIT} AS split, list_distinct({WORDS.format('query')}) AS s, list_distinct(list_filter(list_transform(pos_target, lambda v: {STEM.format('v')}), lambda v: v IS NOT NULL AND v <> '')) AS t FROM query_list"
P2_FOUND = _groups(f"SELECT x.query_id AS a, y.query_id AS b FROM ({SETS}) x JOIN ({SETS}) y ON x.query_id <> y.query_id AND len(x.s) > 0 AND len(y.s) > 0 AND {OVERLAP.format('x.s', 'y.s')} >= 0.7")
IDS = "SELECT record_id, text_name, list_distinct(list_filter(cluster_ids, lambda v: v IS NOT NULL)) AS s FROM data_text_with_cluster_ids"
KEYS = "SELECT record_id, text_name, list_distinct(list_filter(list_transform(keywords, lambda v: {0}), lambda v: v IS NOT NULL AND v <> '')) AS s FROM {1}"
KEYS_A, KEYS_B = (KEYS.format(NORM.format("v"), t) for t in ("data_text_keywords", "data_text_with_cluster_ids"))
P3_FOUND = f"""
SELECT 'cluster_ids' AS field_name, x.record_id AS record_id_a, y.record_id AS record_id_b FROM ({IDS}) x JOIN ({IDS}) y
  ON x.record_id < y.record_id AND x.text_name IS DISTINCT FROM y.text_name AND len(x.s) > 0 AND len(y.s) > 0 AND {OVERLAP.format('x.s', 'y.s')} >= 0.75
UNION ALL SELECT 'keywords', least(x.record_id, y.record_id), greatest(x.record_id, y.record_id) FROM ({KEYS_A}) x JOIN ({KEYS_B}) y
  ON x.text_name IS DISTINCT FROM y.text_name AND len(x.s) > 0 AND len(y.s) > 0 AND {OVERLAP.format('x.s', 'y.s')} >= 0.6
"""
BY_NAME = "SELECT 'cluster_ids' AS field_name, record_id, list_sort(s) AS s, true AS l, true AS r FROM ({0}) UNION ALL SELECT 'keywords', record_id, list_sort(s), false, true FROM ({1}) UNION ALL SELECT 'keywords', record_id, list_sort(s), true, false FROM ({2})".format(IDS, KEYS_A, KEYS_B)
P3_CLASSES = f"""
WITH m AS (SELECT * FROM ({BY_NAME}) WHERE len(s) > 0),
c AS (SELECT field_name, s, min(record_id) AS class_id, bool_or(l) AS l, bool_or(r) AS r FROM m GROUP BY field_name, s),
n AS (SELECT x.field_name, x.class_id, count(*) AS n_links FROM c x JOIN c y ON x.field_name = y.field_name AND x.class_id <> y.class_id AND ((x.l AND y.r) OR (x.r AND y.l))
  AND {OVERLAP.format('x.s', 'y.s')} >= CASE x.field_name WHEN 'keywords' THEN 0.6 ELSE 0.75 END GROUP BY ALL)
SELECT field_name, record_id, class_id, coalesce(n_links, 0) AS n_links FROM m JOIN c USING (field_name, s) LEFT JOIN n USING (field_name, class_id)
"""
CONTAINED = "len(list_intersect({0}, {1}))::DOUBLE / len({0})"
P4_FIELD = "SELECT '{0}' AS field, x.query_id AS eval_id, y.query_id AS train_id, {1} AS overlap, {2} AS containment FROM ({3}) x JOIN ({3}) y ON x.split IN ('validation', 'test') AND y.split = 'train' AND least(len(x.{4}), len(y.{4})) >= {5} AND {1} >= {6}"
P4_PAIRS = " UNION ALL ".join(P4_FIELD.format(f, OVERLAP.format(f"x.{c}", f"y.{c}"), CONTAINED.format(f"x.{c}", f"y.{c}"), SETS, c, n, share) for f, c, n, share in (("query", "s", 1, 0.7), ("pos_target", "t", 3, 0.8)))
P4_CONTAINMENT = f"SELECT field, eval_id, train_id, round(overlap, 6) AS overlap, round(containment, 6) AS containment FROM ({P4_PAIRS})"
P4_FOUND = f"SELECT DISTINCT least(eval_id, train_id) AS query_id_a, greatest(eval_id, train_id) AS query_id_b FROM ({P4_PAIRS})"
P4_REPORT = f"""
SELECT {SPLIT} AS split, source, count(DISTINCT query_id) AS leaked_records, count(*) AS pairs, count(*) FILTER (c = 1) AS contained_pairs, round(max(c), 6) AS best_containment
FROM query_list JOIN (SELECT eval_id, train_id, max(containment) AS c FROM ({P4_PAIRS}) GROUP BY ALL) ON query_id = eval_id GROUP BY 1, 2
"""
TIES = f"""
SELECT DISTINCT query_id AS r, 't' || {STEM.format('v')} AS e FROM (SELECT query_id, unnest(pos_target_for_deepseek) AS v FROM query_list) WHERE v IS NOT NULL AND {STEM.format('v')} <> ''
UNION ALL SELECT query_id, 'q' || {NORM.format('query')} FROM query_list WHERE query IS NOT NULL AND {NORM.format('query')} <> ''
"""
P5_FOUND = _groups(f"SELECT DISTINCT x.r AS a, y.r AS b FROM ({TIES}) x JOIN ({TIES}) y ON x.e = y.e AND x.r <> y.r")
P7_ROUND_TRIP = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
GRAMS = "SELECT {0} AS id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT {0}, ws, unnest(range(1, len(ws) - 10)) AS i FROM (SELECT {0}, {1} AS ws FROM {2}))"
P8_FOUND = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({GRAMS.format('doc_id', WORDS.format('text'), 'documents')}) d JOIN ({GRAMS.format('item_id', WORDS.format('item_text'), 'eval_items')}) i USING (g)"
P8_ITEMS = f"SELECT item_id, item_split, count(*) AS n_docs FROM ({P8_FOUND}) JOIN eval_items USING (item_id) GROUP BY ALL"
P8_CLEAN = f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P8_FOUND}))"
