"""DuckDB SQL of the queries of this subpackage that SQL can express. The others are tested against brute force."""

from larder.llm.survivors import UNKNOWN
from larder.plans.oracles import decoded, folded, in_list


def _words(x: str) -> str:
    return f"regexp_extract_all({folded(decoded(x))}, '[a-z0-9]+')"


def _known(x: str) -> str:
    plain = f"trim(regexp_replace(strip_accents(lower(replace(replace({x}, '&nbsp;', ' '), '&#160;', ' '))), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
    bare = f"regexp_replace({plain}, '^[\\p{{P}}\\p{{S}}\\s]+|[\\p{{P}}\\p{{S}}\\s]+$', '', 'g')"
    return f"({x} IS NOT NULL AND {bare} <> '' AND {bare} NOT IN {in_list(UNKNOWN)} AND {plain} NOT IN {in_list(UNKNOWN)})"


_LINES = "lines AS (SELECT DISTINCT recipe_id, line_position, raw_text FROM ingredients)"


def _texts(column: str) -> str:
    return f"{_LINES}, texts AS (SELECT site_recipe_id AS r, {column} AS t FROM recipes UNION ALL SELECT recipe_id, raw_text FROM lines), flat AS (SELECT r, unnest({_words('t')}) AS w FROM texts)"


def _vectors(table: str, content: str, flat: str) -> str:
    return f"""{content}_v AS (SELECT DISTINCT recipe_id AS r, {flat} FROM {table} WHERE run_id = (SELECT max(run_id) FROM {table})),
      {content}_e AS (SELECT r, unnest(k) AS k, unnest(w)::DOUBLE AS w FROM {content}_v WHERE len(w) > 0),
      {content}_u AS (SELECT r, k, w / sqrt(sum(w * w) OVER (PARTITION BY r)) AS w FROM {content}_e QUALIFY sum(w * w) OVER (PARTITION BY r) > 0),
      {content}_p AS (SELECT a.r AS a, b.r AS b, round(sum(a.w * b.w), 9) AS s FROM {content}_u a JOIN {content}_u b ON a.k = b.k AND a.r <> b.r GROUP BY ALL)"""


_SPACES = f"""{_vectors('document_embeddings', 'embedding', 'range(64) AS k, vec AS w')}, {_vectors('document_vectors', 'tfidf', 'term_ids AS k, weights AS w')},
  near AS (SELECT 'embedding' AS space, * FROM embedding_p WHERE s >= 0.85 UNION ALL SELECT 'tfidf', * FROM tfidf_p WHERE s >= 0.60)"""

_GROUPS = r"""link AS (SELECT site_recipe_id AS a, trim(duplicate_of_recipe_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS b FROM recipes),
  ok AS (SELECT a, b FROM link WHERE a <> b AND b IN (SELECT site_recipe_id FROM recipes)), both_ways AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
  reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y), grp AS (SELECT x AS r, least(x, min(y)) AS g FROM reach GROUP BY x)"""

_AT = "trim(retrieved_at)"
_ZONE = rf"replace(regexp_extract({_AT}, '([+-]\d{{2}}:?\d{{2}})$', 1), ':', '')"
_INSTANT = rf"""CASE WHEN regexp_full_match({_AT}, '\d{{1,11}}') THEN try_cast({_AT} AS BIGINT) * 1000000 WHEN regexp_full_match({_AT}, '\d{{12,13}}') THEN try_cast({_AT} AS BIGINT) * 1000
  WHEN regexp_full_match({_AT}, '\d{{8}}T\d{{6}}Z') THEN epoch_us(try_strptime({_AT}, '%Y%m%dT%H%M%SZ')) WHEN regexp_matches({_AT}, '^\d{{2}}/\d{{2}}/\d{{4}} ') THEN epoch_us(try_strptime({_AT}, '%d/%m/%Y %H:%M:%S'))
  ELSE epoch_us(try_strptime(replace({_AT}[:19], 'T', ' '), '%Y-%m-%d %H:%M:%S')) + coalesce(try_cast('0' || regexp_extract({_AT}, ':\d{{2}}(\.\d+)', 1) AS DOUBLE) * 1000000, 0)::BIGINT
    - CASE WHEN {_ZONE} = '' THEN 0 ELSE (CASE WHEN {_ZONE}[1] = '-' THEN -1 ELSE 1 END) * (try_cast({_ZONE}[2:3] AS BIGINT) * 3600 + try_cast({_ZONE}[4:5] AS BIGINT) * 60) * 1000000 END END"""

_PICKS = " UNION ALL ".join(
    [f"SELECT g, 'rating_value' AS f, arg_min(site_recipe_id, (-coalesce(ratings_count, -1), site_recipe_id)) AS s FROM m WHERE rating_value IS NOT NULL GROUP BY g",
     f"SELECT g, 'description', arg_min(site_recipe_id, (-length(trim(description)), site_recipe_id)) FROM m WHERE {_known('description')} GROUP BY g"]
    + [f"SELECT g, '{f}', arg_min(site_recipe_id, (-coalesce(at_us, -99999999999999999), site_recipe_id)) FROM m WHERE {_known(f)} GROUP BY g" for f in ("prep_time_raw", "difficulty", "cost_label")]
    + ["SELECT g, 'servings', arg_min(site_recipe_id, (-coalesce(at_us, -99999999999999999), site_recipe_id)) FROM m WHERE servings IS NOT NULL GROUP BY g"])

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_SPACES}, top AS (SELECT *, row_number() OVER (PARTITION BY space, a ORDER BY s DESC, b) AS k FROM near)
      SELECT DISTINCT space, least(a, b) AS recipe_id_a, greatest(a, b) AS recipe_id_b FROM top WHERE k <= 5""",
    "p1_neighbours": f"""WITH {_SPACES}, top AS (SELECT *, row_number() OVER (PARTITION BY space, a ORDER BY s DESC, b) AS k FROM near)
      SELECT space, a AS recipe_id, b AS neighbour_id, s AS similarity FROM top WHERE k <= 5""",
    "p2_found": f"""WITH RECURSIVE {_SPACES}, reach(space, x, y) AS (SELECT space, a, b FROM near UNION SELECT r.space, r.x, n.b FROM reach r JOIN near n ON n.space = r.space AND n.a = r.y),
      grp AS (SELECT space, x AS r, least(x, min(y)) AS g, count(DISTINCT y) AS n FROM reach GROUP BY space, x) SELECT space, g AS cluster_recipe_id, r AS recipe_id FROM grp WHERE n >= 3""",
    "p3_found": f"WITH RECURSIVE {_GROUPS}, m AS (SELECT r.*, g, {_INSTANT} AS at_us FROM recipes r JOIN grp ON grp.r = r.site_recipe_id), picks AS ({_PICKS}) SELECT g AS group_recipe_id, f AS field_name, s AS source_recipe_id FROM picks",
    "p5_found": f"""WITH {_texts('title')}, s AS (SELECT DISTINCT r, w FROM flat), n AS (SELECT r, count(*) AS n FROM s GROUP BY r HAVING count(*) >= 12), k AS (SELECT s.r, w, n FROM s JOIN n USING (r)),
      p AS (SELECT a.r AS a, b.r AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.w = b.w AND a.r < b.r GROUP BY ALL) SELECT a AS recipe_id_a, b AS recipe_id_b FROM p WHERE 5 * x >= 4 * (na + nb - x)""",
    "p6_found": f"""WITH {_texts('search_text')}, tf AS (SELECT r, w, count(*) AS tf FROM flat WHERE length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w HAVING count(*) >= 2),
      sc AS (SELECT r, w, round(tf * ln((SELECT count(*) FROM recipes) * 1.0::DOUBLE / df), 9) AS s FROM tf JOIN df USING (w)) SELECT r AS recipe_id, w AS term FROM sc QUALIFY row_number() OVER (PARTITION BY r ORDER BY s DESC, w) <= 3""",
    "p3_records": f"""WITH RECURSIVE {_GROUPS}, m AS (SELECT r.*, g, {_INSTANT} AS at_us FROM recipes r JOIN grp ON grp.r = r.site_recipe_id), picks AS ({_PICKS}),
      v AS (SELECT p.g, p.f, r.* FROM picks p JOIN recipes r ON r.site_recipe_id = p.s)
      SELECT k.g AS group_recipe_id, {', '.join(f"any_value(v.{c}) FILTER (WHERE v.f = '{c}') AS {c}" for c in ('rating_value', 'description', 'prep_time_raw', 'difficulty', 'cost_label', 'servings'))}
      FROM (SELECT DISTINCT g FROM grp) k LEFT JOIN v ON v.g = k.g GROUP BY k.g""",
    "p5_groups": f"""WITH RECURSIVE {_texts('title')}, s AS (SELECT DISTINCT r, w FROM flat), n AS (SELECT r, count(*) AS n FROM s GROUP BY r HAVING count(*) >= 12), k AS (SELECT s.r, w, n FROM s JOIN n USING (r)),
      p AS (SELECT a.r AS a, b.r AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.w = b.w AND a.r <> b.r GROUP BY ALL), near AS (SELECT a, b, x = na AND x = nb AS same FROM p WHERE 5 * x >= 4 * (na + nb - x)),
      reach(x, y) AS (SELECT a, b FROM near UNION SELECT r.x, e.b FROM reach r JOIN near e ON e.a = r.y), g AS (SELECT x AS r, min(y) AS y FROM reach GROUP BY x)
      SELECT n.r AS recipe_id, least(n.r, coalesce(min(b) FILTER (WHERE same), n.r)) AS class_id, count(b) AS links, least(n.r, coalesce(any_value(g.y), n.r)) AS group_id FROM n LEFT JOIN near ON near.a = n.r LEFT JOIN g ON g.r = n.r GROUP BY n.r""",
    "p6_terms": f"""WITH {_texts('search_text')}, tf AS (SELECT r, w, count(*) AS tf FROM flat WHERE length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM recipes), len AS (SELECT r, sum(tf)::DOUBLE AS dl FROM tf GROUP BY r),
      mean AS (SELECT sum(dl) / any_value(n.n) AS avgdl FROM len, n), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w HAVING count(*) >= 2),
      sc AS (SELECT r, w, tf, df, round(ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM tf JOIN df USING (w) JOIN len USING (r), n, mean)
      SELECT r AS recipe_id, w AS term, rank::INT AS rank, tf, df, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, w) AS rank FROM sc) WHERE rank <= 3""",
}
