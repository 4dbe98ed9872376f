"""DuckDB statements for queries of the operators for training data."""


def _p3(tab: str, k: str, text: str, limit: int) -> str:
    trimmed = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    return rf"""
SELECT '{tab}' AS tab_name, row_key, CASE
  WHEN len(list_filter(paragraphs, lambda x: length({trimmed}) > {limit})) = 0 THEN 'paragraph'
  WHEN len(list_filter(string_split(array_to_string(list_transform(paragraphs, lambda x: regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)), chr(1)), lambda x: length({trimmed}) > {limit})) = 0 THEN 'sentence'
  WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: length(x) > {limit})) = 0 THEN 'word' ELSE 'char' END AS finest_cut
FROM (SELECT row_key, t, regexp_split_to_array(t, '\f|(^|\n)([ \t\r]*(\n|$))+') AS paragraphs
  FROM (SELECT min({k}) AS row_key, max({text}) AS t FROM {tab} WHERE length({text}) > {limit} GROUP BY lower(trim({k}, ' \t'))))"""


_WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
_ROWS = "SELECT min(clause_id) AS id, max(clause_text) AS t FROM clauses WHERE trim(clause_id, ' \t') <> '' GROUP BY lower(trim(clause_id, ' \t'))"
_LINKS = f"""w AS (SELECT c, {_WORDS.format(t='t')} AS w FROM (SELECT min(id) AS c, t FROM r WHERE t IS NOT NULL GROUP BY t)),
s AS (SELECT c, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 40),
g AS (SELECT c, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2 HAVING count(*) * 2 >= any_value(a.n) + any_value(b.n) - count(*))"""

_RUN = 20
_GRAMS = """SELECT DISTINCT id, array_to_string(w[i:i + {n} - 1], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT {id} AS id, {words} AS w FROM {tab} WHERE text IS NOT NULL))"""
_LIMITED = "SELECT '{tab}' AS tab_name, min({k}) AS row_key, true AS rejoined, true AS within_limit, true AS overlap_repeats, true AS ordered FROM {tab} WHERE length({t}) > {n} AND trim({k}, ' \t') <> '' GROUP BY lower(trim({k}, ' \t'))"

SQL: dict[str, str] = {
    "p3_found": _p3("documents", "document_id", "file_text", 12_000) + " UNION ALL " + _p3("clauses", "clause_id", "clause_text", 2_400),
    "p2_found": f"""WITH r AS ({_ROWS}), {_LINKS},
m AS (SELECT id, min(id) OVER (PARTITION BY t) AS c, len({_WORDS.format(t='t')}) AS n FROM r WHERE t IS NOT NULL)
SELECT least(x.id, y.id) AS clause_id_a, greatest(x.id, y.id) AS clause_id_b FROM l JOIN m x ON x.c = l.a JOIN m y ON y.c = l.b
UNION ALL SELECT x.id, y.id FROM m x JOIN m y ON x.c = y.c AND x.id < y.id WHERE x.n >= 40""",
    "p2_groups": f"""WITH RECURSIVE r AS ({_ROWS}), {_LINKS},
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
m AS (SELECT id, CASE WHEN t IS NULL THEN id ELSE min(id) OVER (PARTITION BY t) END AS c FROM r),
p AS (SELECT a AS c, a AS o FROM e UNION SELECT p.c, e.b FROM p JOIN e ON p.o = e.a)
SELECT id AS clause_id, coalesce((SELECT min(o) FROM p WHERE p.c = m.c), m.c) AS group_id, (SELECT count(*) FROM e WHERE e.a = m.c) AS n_links FROM m""",
    "p3_rejoined": _LIMITED.format(tab="documents", k="document_id", t="file_text", n=12_000) + " UNION ALL " + _LIMITED.format(tab="clauses", k="clause_id", t="clause_text", n=2_400),
    "p6_found": f"""WITH i AS ({_GRAMS.format(n=_RUN, id='item_id', words=_WORDS.format(t='text'), tab='eval_items')}), d AS ({_GRAMS.format(n=_RUN, id='doc_id', words=_WORDS.format(t='text'), tab='documents')})
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i ON d.g = i.g""",
    "p7_found": """WITH t AS (SELECT DISTINCT mix_name, budget_ratio, source, target_share, max_repeats FROM mix_targets WHERE source IS NOT NULL),
d AS (SELECT source, sum(length(coalesce(text, ''))) AS n FROM documents GROUP BY 1)
SELECT mix_name, t.source FROM t LEFT JOIN d ON t.source = d.source WHERE coalesce(n, 0) * greatest(1, coalesce(max_repeats, 1)) < target_share * budget_ratio * (SELECT sum(n) FROM d)""",
    "p7_limits": "SELECT DISTINCT mix_name, source, true AS repeats_ok, true AS share_ok FROM mix_targets WHERE source IS NOT NULL",
}
