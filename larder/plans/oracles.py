"""The queries' SQL for DuckDB, written apart from the operators: text rules as SQL expressions, the rest as plain SQL."""

from __future__ import annotations

from larder import lexicons as L

# Entities and compatibility characters that occur in the tables, with their plain text.
ENTITIES = {f"&{base}{mark};": chr(code) for mark, pairs in {
    "acute": (("a", 225), ("e", 233), ("i", 237), ("o", 243), ("u", 250), ("A", 193), ("E", 201), ("I", 205), ("O", 211), ("U", 218)),
    "circ": (("a", 226), ("e", 234), ("o", 244), ("A", 194), ("E", 202), ("O", 212)),
    "tilde": (("a", 227), ("o", 245), ("n", 241), ("A", 195), ("O", 213), ("N", 209)),
    "grave": (("a", 224), ("A", 192)), "cedil": (("c", 231), ("C", 199)), "uml": (("u", 252),)}.items() for base, code in pairs}
ENTITIES |= {f"&#{code};": chr(code) for code in (39, 64, 160, 192, 193, 194, 195, 199, 201, 202, 205, 211, 212, 213, 218, 224, 225, 226, 227, 231, 233, 234, 237, 241, 243, 244, 245, 250, 252)}
ENTITIES |= {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
COMPATIBLE = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "º": "o", "ª": "a", "№": "No", "ß": "ss", "²": "2", "³": "3"}
SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, {_text(a)}, {_text(b)})"
    return x


def decoded(x: str) -> str:
    x = f"coalesce({x}, '')"
    for _ in range(2):
        x = f"replace(replace({x}, '&amp;', '&'), '&AMP;', '&')"
    return _replaced(x, ENTITIES)


def clean(x: str) -> str:
    return rf"trim(regexp_replace({decoded(x)}, '{SPACE}', ' ', 'g'))"


def folded(x: str) -> str:
    """Folded without the compatibility letter that stays capital."""
    return f"strip_accents({_replaced(f'lower({x})', {k: v for k, v in COMPATIBLE.items() if k != '№'} | {'№': 'No'})})"


def words(x: str) -> str:
    """Word tokens after removal of markup and URLs."""
    bare = rf"regexp_replace(regexp_replace({clean(x)}, '</?[a-zA-Z][^>]*>', ' ', 'g'), '(?i)https?://\S+|www\.\S+', ' ', 'g')"
    return f"regexp_extract_all({folded(bare)}, '[A-Za-z0-9]+')"


def in_list(items) -> str:
    return "(" + ", ".join(_text(i) for i in items) + ")"


def content(w: str) -> str:
    return f"list_filter({w}, lambda t: t NOT IN {in_list(L.STOPWORDS)})"


def case_map(x: str, pairs) -> str:
    return f"CASE {' '.join(f'WHEN {x} = {_text(k)} THEN {_text(v) if isinstance(v, str) else v}' for k, v in pairs.items())} END"


def stem(x: str) -> str:
    return "CASE " + " ".join(f"WHEN length({x}) >= {len(s) + 3} AND {x} LIKE '%{s}' THEN {x}[:-{len(s) + 1}]" for s in L.SUFFIXES) + f" ELSE {x} END"


def lemma(x: str) -> str:
    return f"""coalesce({case_map(x, L.LEMMAS)}, CASE WHEN length({x}) > 5 AND {x} LIKE '%oes' THEN {x}[:-4] || 'ao'
      WHEN length({x}) > 5 AND {x} LIKE '%ais' THEN {x}[:-4] || 'al' WHEN length({x}) > 4 AND {x} LIKE '%es' THEN {x}[:-3]
      WHEN length({x}) > 4 AND {x} LIKE '%s' THEN {x}[:-2] ELSE {x} END)"""


def nocase(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


DOCS = f"docs AS (SELECT doc_id AS key, {content(words('text'))} AS tokens FROM documents)"
_CHILD = "SELECT DISTINCT recipe_id, '{0}', line_position, raw_text FROM {1} WHERE raw_text IS NOT NULL AND recipe_id IS NOT NULL"
UNITS = f"""units AS (SELECT site_recipe_id AS r, 'title' AS f, 0 AS p, title AS t FROM recipes WHERE title IS NOT NULL UNION ALL SELECT site_recipe_id, 'description', 0, description FROM recipes WHERE description <> ''
  UNION ALL {_CHILD.format('ingredient', 'ingredients')} UNION ALL {_CHILD.format('preparation_step', 'preparation_steps')})"""
UNIT_WORDS = f"{UNITS}, uw AS (SELECT r, f, p, {words('t')} AS w FROM units), uc AS (SELECT *, {content('w')} AS c FROM uw)"
RECIPES = f"""{UNIT_WORDS}, ul AS (SELECT r, f, p, unnest(range(len(c))) AS i, unnest(c) AS t FROM uc), un AS (SELECT r, f, p, {lemma('t')} AS l, min(i) AS i FROM ul GROUP BY ALL),
  lists AS (SELECT r, list(l ORDER BY f, p, i) AS tokens FROM un WHERE l <> '' GROUP BY r),
  docs AS (SELECT site_recipe_id AS key, coalesce(tokens, []) AS tokens FROM recipes LEFT JOIN lists ON r = site_recipe_id WHERE trim(coalesce(duplicate_of_recipe_id, '')) = '')"""
TF = "tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM docs) GROUP BY ALL)"
WEIGHTS = f"""{TF}, n AS (SELECT count(*) AS n FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT key, term, tf, ln(n.n * 1.0 / df.df) AS idf, tf * ln(n.n * 1.0 / df.df) AS tfidf FROM tf JOIN df USING (term), n)"""
PAIRS = f"""{RECIPES}, pos AS (SELECT key, unnest(range(1, len(tokens) + 1)) AS i, tokens FROM docs), tok_at AS (SELECT key, i, tokens[i] AS term FROM pos),
  pairs AS (SELECT a.term, b.term AS context, sum(1.0::DOUBLE / abs(a.i - b.i)) AS weight FROM tok_at a JOIN tok_at b ON a.key = b.key AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY ALL)"""
PPMI = f"""{PAIRS}, r AS (SELECT term, sum(weight) AS r FROM pairs GROUP BY term), k AS (SELECT context, sum(weight) AS k FROM pairs GROUP BY context), t AS (SELECT sum(weight) AS t FROM pairs),
  ppmi AS (SELECT term, context, ln(weight * t / (r * k)) AS ppmi FROM pairs JOIN r USING (term) JOIN k USING (context), t WHERE ln(weight * t / (r * k)) > 0)"""


def sign(term: str, i: str) -> str:
    return f"CASE WHEN sha256({term} || ':' || {i})[2] IN ('0','2','4','6','8','a','c','e') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


VECTORS = f"""{PPMI}, ctx AS (SELECT DISTINCT context FROM ppmi), dims AS (SELECT unnest(range(32)) AS i),
  signs AS (SELECT context, i, {sign('context', 'i')} AS s FROM ctx, dims),
  raw AS (SELECT term, i, sum(ppmi * s) / sqrt(32.0::DOUBLE) AS v FROM ppmi JOIN signs USING (context) GROUP BY ALL),
  vec AS (SELECT term, i, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY term)), 0) AS v FROM raw)"""
DOCVEC = f"""{VECTORS}, mean AS (SELECT a.key, vec.i, avg(vec.v) AS m FROM tok_at a JOIN vec ON vec.term = a.term GROUP BY ALL),
  dv AS (SELECT key, i, m / nullif(sqrt(sum(m * m) OVER (PARTITION BY key)), 0) AS v FROM mean)"""

LABELED = f"""{RECIPES}, lab AS (SELECT key, {case_map(folded(clean('difficulty')), L.DIFFICULTIES)} AS label, tokens FROM docs JOIN recipes ON site_recipe_id = key),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(label || ':' || key), key) AS rank, count(*) OVER (PARTITION BY label) AS n FROM lab WHERE label IS NOT NULL),
  split AS (SELECT key, label, tokens, CASE WHEN n >= 2 AND rank <= least(n - 1, greatest(1, round_even(n * 0.25::DOUBLE, 0)::BIGINT)) THEN 'test' ELSE 'train' END AS split FROM ranked),
  train AS (SELECT * FROM split WHERE split = 'train'),
  pri AS (SELECT label, count(*) AS documents, ln((count(*) + 1.0::DOUBLE) / ((SELECT count(*) FROM train) + 1.0::DOUBLE * (SELECT count(DISTINCT label) FROM train))) AS log_prior FROM train GROUP BY label),
  flat AS (SELECT label, unnest(tokens) AS term FROM train), cnt AS (SELECT label, term, count(*) AS count FROM flat GROUP BY ALL),
  v AS (SELECT greatest(1, count(DISTINCT term)) AS v FROM flat), den AS (SELECT label, sum(len(tokens)) + v * 1.0::DOUBLE AS den FROM train, v GROUP BY label, v)"""
PREDICTED = f"""{LABELED}, tst AS (SELECT key, label AS actual, unnest(tokens) AS term FROM split WHERE split = 'test'), known AS (SELECT t.* FROM tst t WHERE term IN (SELECT term FROM flat)),
  grid AS (SELECT s.key, s.label AS actual, p.label, p.log_prior FROM split s, pri p WHERE s.split = 'test'),
  score AS (SELECT g.key, g.actual, g.label, round(g.log_prior + coalesce(sum(ln((coalesce(c.count, 0) + 1.0::DOUBLE) / d.den)) FILTER (WHERE k.term IS NOT NULL), 0), 6) AS score
     FROM grid g JOIN den d USING (label) LEFT JOIN known k ON k.key = g.key LEFT JOIN cnt c ON c.label = g.label AND c.term = k.term GROUP BY g.key, g.actual, g.label, g.log_prior),
  best AS (SELECT key, actual, max(score) AS top, max_by(label, (score, label)) AS predicted FROM score GROUP BY ALL),
  pred AS (SELECT b.key, b.actual, b.predicted, 1 / sum(exp(s.score - b.top)) AS confidence FROM best b JOIN score s USING (key) GROUP BY b.key, b.actual, b.predicted)"""
MATRIX = f"""{PREDICTED}, labels AS (SELECT actual AS l FROM pred UNION SELECT predicted FROM pred),
  m AS (SELECT a.l AS actual, p.l AS predicted, count(x.key) AS count FROM labels a CROSS JOIN labels p LEFT JOIN pred x ON x.actual = a.l AND x.predicted = p.l GROUP BY ALL)"""
METRICS = f"""{MATRIX}, per AS (SELECT l AS label, (SELECT sum(count) FROM m WHERE actual = l AND predicted = l) AS hit, (SELECT sum(count) FROM m WHERE actual = l) AS support, (SELECT sum(count) FROM m WHERE predicted = l) AS chosen FROM labels),
  pr AS (SELECT label, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END::DOUBLE AS recall, support::BIGINT AS support FROM per),
  met AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM pr)"""

STEPS = "steps AS (SELECT DISTINCT recipe_id, line_position AS position, raw_text FROM preparation_steps WHERE raw_text IS NOT NULL AND recipe_id IS NOT NULL)"
PARSED = f"""{STEPS}, tok AS (SELECT recipe_id, position, {words('raw_text')} AS w FROM steps), one AS (SELECT recipe_id, position, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS token FROM tok),
  lem AS (SELECT *, coalesce({case_map('token', L.VERB_FORMS)}, {lemma('token')}) AS lemma FROM one),
  root AS (SELECT *, coalesce(min(i) FILTER (WHERE lemma IN {in_list(L.VERBS)}) OVER (PARTITION BY recipe_id, position), 0) AS r FROM lem),
  obj AS (SELECT *, min(i) FILTER (WHERE i > r AND token NOT IN {in_list((*L.DETERMINERS, *L.PREPOSITIONS))}) OVER (PARTITION BY recipe_id, position) AS o FROM root),
  dep AS (SELECT recipe_id, position, i::INT AS token_index, token, lemma, CASE WHEN i = r THEN NULL WHEN token IN {in_list((*L.DETERMINERS, *L.PREPOSITIONS))} THEN least(i + 1, n - 1) ELSE r END::INT AS head_index,
    CASE WHEN i = r THEN 'root' WHEN token IN {in_list(L.DETERMINERS)} THEN 'det' WHEN token IN {in_list(L.PREPOSITIONS)} THEN 'case' WHEN i < r THEN 'nsubj' WHEN i = o THEN 'obj' ELSE 'nmod' END AS relation FROM obj)"""

POLARITY = L.POLARITY | {"otimo": 1.7, "delicia": 1.5, "fofinho": 1.0, "dourado": 0.8, "cremoso": 1.0, "pesado": -1.0, "graca": 0.5}
SENTIMENT = f"""dw AS (SELECT doc_id, {words('text')} AS w FROM documents), tk AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM dw),
  ctx AS (SELECT doc_id, t, bool_or(t IN {in_list(L.NEGATIONS)}) OVER p AS neg, max(coalesce({case_map('t', L.INTENSIFIERS)}, 1.0)::DOUBLE) OVER p AS force FROM tk WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  ev AS (SELECT doc_id, count(*) AS n, sum({case_map('t', POLARITY)}::DOUBLE * coalesce(force, 1.0) * CASE WHEN coalesce(neg, false) THEN -1 ELSE 1 END) AS total FROM ctx WHERE t IN {in_list(POLARITY)} GROUP BY doc_id),
  sc AS (SELECT d.doc_id, d.w, coalesce(n, 0) AS n, greatest(-1.0, least(1.0, coalesce(total, 0) / greatest(1.0, coalesce(n, 0) * 1.5))) AS score FROM dw d LEFT JOIN ev USING (doc_id)),
  se AS (SELECT doc_id, w, n, score, CASE WHEN score > 0.1 THEN 'positivo' WHEN score < -0.1 THEN 'negativo' ELSE 'neutro' END AS polarity FROM sc)"""

POINTS = """raw AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  pt AS (SELECT vec_id, label, i, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 0) AS v FROM raw), ctr AS (SELECT label, i, avg(v) AS c FROM pt GROUP BY ALL)"""

LISTED = """seen AS (SELECT DISTINCT category_id, recipe_id FROM category_listings WHERE category_id IS NOT NULL AND recipe_id IS NOT NULL),
  hit AS (SELECT r.site_recipe_id, s.category_id FROM recipes r JOIN seen s ON s.recipe_id = r.site_recipe_id UNION SELECT r.site_recipe_id, s.category_id FROM recipes r JOIN seen s ON s.recipe_id = r.url)"""
CANON = r"CASE WHEN regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) <> '' THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) ELSE regexp_extract(u, '^([^?#]*)', 1) END"
SLUG = r"regexp_extract(regexp_extract(category_url, '^([^?#]*)', 1), '/categorias/([^/?#]+)', 1)"
TITLED = rf"list_aggregate(list_transform(string_split(replace(regexp_replace({SLUG}, '^\d+-?', ''), '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')"
ORDER = f"rating_value DESC NULLS LAST, ratings_count DESC NULLS LAST, {nocase('title')}, site_recipe_id"
DIFF = f"nullif(coalesce({case_map(folded(clean('difficulty')), L.DIFFICULTIES)}, lower({clean('difficulty')})), '')"
COST = f"nullif(coalesce({case_map(folded(clean('cost_label')), L.COSTS)}, {clean('cost_label')}), '')"


def label(x: str) -> str:
    return f"coalesce(nullif(trim({x}), ''), 'Não informado')"


SQL: dict[str, str] = {
    "text_clean": f"WITH {UNITS} SELECT r AS recipe_id, f AS field_name, p AS position, {clean('t')} AS clean FROM units",
    "text_words": f"WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS words, len(w)::INT AS n_words FROM w",
    "stopword_filter": f"WITH {STEPS.replace('WHERE raw_text IS NOT NULL AND recipe_id IS NOT NULL', '')} SELECT recipe_id, position AS line_position, array_to_string({content(words('raw_text'))}, ' ') AS content FROM steps",
    "stem_lemma": f"WITH {UNIT_WORDS}, d AS (SELECT DISTINCT unnest(c) AS word FROM uc) SELECT word, {stem('word')} AS stem, {lemma('word')} AS lemma FROM d",
    "prepare_keys": f"""WITH {UNIT_WORDS} SELECT r AS recipe_id, f AS field_name, p AS position, sha256(array_to_string(w, ' ')) AS duplicate_key, sha256(array_to_string(list_sort(list_distinct(c)), ' ')) AS near_duplicate_key, len(w)::INT AS n_tokens, len(c)::INT AS n_content_tokens,
      len(list_distinct(list_filter(list_transform(c, lambda t: {stem('t')}), lambda t: t <> '')))::INT AS n_stemmed_tokens, len(list_distinct(list_filter(list_transform(c, lambda t: {lemma('t')}), lambda t: t <> '')))::INT AS n_lemma_tokens, {_text(L.PREPARATION_VERSION)} AS version FROM uc""",
    "search_index": f"""WITH {UNIT_WORDS} SELECT r AS recipe_id, f AS field_name, p AS position, array_to_string(list_sort(list_distinct(list_concat(w, list_transform(c, lambda t: {stem('t')}), list_transform(c, lambda t: {lemma('t')})))), ' ') AS words FROM uc""",
    "search_texts": f"""WITH t AS (SELECT site_recipe_id AS r, title AS t FROM recipes UNION ALL SELECT site_recipe_id, description FROM recipes UNION ALL SELECT site_recipe_id, origin_category FROM recipes
      UNION ALL SELECT recipe_id, raw_text FROM ingredients UNION ALL SELECT recipe_id, raw_text FROM preparation_steps), w AS (SELECT DISTINCT r, unnest({words('t')}) AS w FROM t),
      a AS (SELECT r, w FROM w UNION SELECT r, {stem('w')} FROM w WHERE w NOT IN {in_list(L.STOPWORDS)} UNION SELECT r, {lemma('w')} FROM w WHERE w NOT IN {in_list(L.STOPWORDS)})
      SELECT site_recipe_id AS recipe_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS words FROM recipes LEFT JOIN a ON a.r = site_recipe_id GROUP BY 1""",
    "near_dup_groups": f"WITH {DOCS}, k AS (SELECT key, sha256(array_to_string(list_sort(list_distinct(tokens)), ' ')) AS near_key FROM docs WHERE len(tokens) > 0) SELECT near_key, count(*) AS copies, min(key) AS first_doc FROM k GROUP BY near_key HAVING count(*) > 1",
    "document_copies": "WITH g AS (SELECT text, min(doc_id) AS canonical FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1) SELECT doc_id::VARCHAR AS doc_id, canonical::VARCHAR AS canonical FROM documents JOIN g USING (text) WHERE doc_id <> canonical",
    "tfidf_vocabulary": f"WITH {DOCS}, {WEIGHTS} SELECT term, df.df, round(ln(n.n * 1.0 / df.df), 6) AS idf FROM df, n",
    "tfidf_weights": f"WITH {DOCS}, {WEIGHTS} SELECT key AS doc_id, term, tf, round(tfidf, 6) AS tfidf FROM w",
    "tfidf_top_terms": f"WITH {DOCS}, {WEIGHTS} SELECT key AS doc_id, term, tf, round(tfidf, 6) AS tfidf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(tfidf, 9) DESC, tf DESC, term) AS rank FROM w) WHERE rank <= 8",
    "doc_norms": f"WITH {DOCS}, {WEIGHTS} SELECT key AS doc_id, round(sqrt(sum(tfidf * tfidf)), 6) AS norm FROM w GROUP BY key",
    "top_tokens": f"WITH {DOCS}, {TF} SELECT key AS doc_id, term, tf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tf DESC, term) AS rank FROM tf) WHERE rank <= 8",
    "recipe_tfidf_top_terms": f"WITH {RECIPES}, {WEIGHTS} SELECT key AS recipe_id, term, tf, round(tfidf, 6) AS tfidf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(tfidf, 9) DESC, tf DESC, term) AS rank FROM w) WHERE rank <= 8",
    "exact_dup_groups": f"""WITH {UNIT_WORDS}, n AS (SELECT r, f, p, array_to_string(w, ' ') AS n FROM uw), g AS (SELECT r, coalesce(string_agg(n, ' ' ORDER BY f, p, n) FILTER (WHERE f IN ('ingredient', 'preparation_step')), '') AS lists,
      coalesce(max(n) FILTER (WHERE f = 'description'), '') AS about, coalesce(max(n) FILTER (WHERE f = 'title'), '') AS title FROM n GROUP BY r), k AS (SELECT r, title || ' ' || CASE WHEN lists <> '' THEN lists ELSE about END AS k FROM g WHERE lists <> '' OR about <> ''),
      c AS (SELECT k, arg_min(r, (NOT regexp_full_match(r, '[0-9]+'), try_cast(r AS BIGINT), r)) AS canonical FROM k GROUP BY k HAVING count(*) > 1) SELECT r AS recipe_id, canonical, 1.0::DOUBLE AS similarity FROM k JOIN c USING (k) WHERE r <> canonical""",
    "cosine_knn_sparse": f"""WITH {RECIPES}, {WEIGHTS}, u AS (SELECT key, term, CASE WHEN sqrt(sum(tfidf * tfidf) OVER (PARTITION BY key)) > 0 THEN tfidf / sqrt(sum(tfidf * tfidf) OVER (PARTITION BY key)) ELSE 0 END AS w FROM w),
      q AS (SELECT key FROM docs WHERE key::BIGINT % 50 = 0), dots AS (SELECT a.key AS q, b.key AS n, sum(a.w * b.w) AS c FROM u a JOIN u b USING (term) WHERE a.key IN (SELECT key FROM q) GROUP BY ALL),
      every AS (SELECT q.key AS q, d.key AS n, round(coalesce(c, 0), 6) AS cosine FROM q CROSS JOIN docs d LEFT JOIN dots ON dots.q = q.key AND dots.n = d.key WHERE q.key <> d.key)
      SELECT q AS recipe_id, n AS neighbour_id, cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, n) AS rank FROM every) WHERE rank <= 5""",
    "cosine_knn_dense": """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
      SELECT vec_id, neighbour_id, cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour_id) AS rank FROM p) WHERE rank <= 5""",
    "cooccurrence": f"WITH {PAIRS} SELECT term, context, weight FROM pairs",
    "ppmi": f"WITH {PPMI} SELECT term, context, round(ppmi, 6) AS ppmi FROM ppmi",
    "top_contexts": f"WITH {PPMI} SELECT term, context, round(ppmi, 6) AS ppmi, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(ppmi, 9) DESC, context) AS rank FROM ppmi) WHERE rank <= 8",
    "hash_signs": f"WITH {RECIPES}, t AS (SELECT DISTINCT unnest(tokens) AS term FROM docs), i AS (SELECT unnest(range(32))::INT AS i) SELECT term, i, {sign('term', 'i')} AS sign FROM t, i",
    "word_vectors": f"WITH {VECTORS} SELECT term, i::INT AS i, round(v, 5) + 0.0::DOUBLE AS v FROM vec",
    "document_embeddings": f"WITH {DOCVEC} SELECT d.key AS recipe_id, dims.i::INT AS i, round(coalesce(v, 0), 5) + 0.0::DOUBLE AS v FROM docs d CROSS JOIN dims LEFT JOIN dv ON dv.key = d.key AND dv.i = dims.i",
    "contextual_vectors": f"""WITH {VECTORS}, nb AS (SELECT a.key, a.i AS pos, v.i, avg(v.v) AS m FROM tok_at a JOIN tok_at b ON a.key = b.key AND a.i <> b.i AND abs(a.i - b.i) <= 2 JOIN vec v ON v.term = b.term GROUP BY ALL),
      nu AS (SELECT key, pos, i, m / nullif(sqrt(sum(m * m) OVER (PARTITION BY key, pos)), 0) AS m FROM nb), mix AS (SELECT a.key, a.i AS pos, a.term, d.i, 0.5::DOUBLE * coalesce(v.v, 0) + 0.5::DOUBLE * coalesce(nu.m, 0) AS x
      FROM tok_at a CROSS JOIN dims d LEFT JOIN vec v ON v.term = a.term AND v.i = d.i LEFT JOIN nu ON nu.key = a.key AND nu.pos = a.i AND nu.i = d.i),
      o AS (SELECT key, pos, any_value(term) AS term, max(x) FILTER (WHERE i = 0) AS a, max(x) FILTER (WHERE i = 31) AS b, sqrt(sum(x * x)) AS n FROM mix GROUP BY key, pos)
      SELECT key AS recipe_id, (pos - 1)::INT AS pos, term, round(coalesce(a / nullif(n, 0), 0), 4) + 0.0::DOUBLE AS v0, round(coalesce(b / nullif(n, 0), 0), 4) + 0.0::DOUBLE AS v31 FROM o""",
    "semantic_search": f"""WITH {DOCVEC}, q AS (SELECT i, avg(v) AS v FROM vec WHERE term IN ('sobremesa', 'chocolate', 'banana') GROUP BY i), qn AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM q)
      SELECT d.key AS recipe_id, round(coalesce(sum(dv.v * qn.v), 0), 6) AS cosine FROM docs d LEFT JOIN dv ON dv.key = d.key LEFT JOIN qn ON qn.i = dv.i GROUP BY d.key ORDER BY 2 DESC, 1 LIMIT 10""",
    "stratified_split": f"WITH {LABELED} SELECT key AS recipe_id, label, split FROM split",
    "nb_priors": f"WITH {LABELED} SELECT label, documents, round(log_prior, 6) AS log_prior FROM pri",
    "nb_likelihoods": f"WITH {LABELED} SELECT label, term, count, round(ln((count + 1.0::DOUBLE) / den), 6) AS log_likelihood FROM cnt JOIN den USING (label)",
    "nb_predict": f"WITH {PREDICTED} SELECT key AS recipe_id, actual, predicted, round(confidence, 4) AS confidence FROM pred",
    "nb_confusion": f"WITH {MATRIX} SELECT actual, predicted, count FROM m",
    "nb_metrics": f"WITH {METRICS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM met",
    "nb_summary": f"WITH {METRICS} SELECT round((SELECT sum(count) FILTER (WHERE actual = predicted) / sum(count) FROM m), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM met",
    "dependency_parse": f"WITH {PARSED} SELECT * FROM dep",
    "dependency_counts": f"WITH {PARSED} SELECT relation, count(*) AS count FROM dep GROUP BY relation",
    "action_relations": f"WITH {PARSED} SELECT recipe_id, position, max(lemma) FILTER (WHERE relation = 'root') AS subject, max(lemma) FILTER (WHERE relation = 'obj') AS object FROM dep GROUP BY ALL HAVING object IS NOT NULL",
    "linguistic_counts": f"WITH {PARSED} SELECT (SELECT count(*) FROM steps) AS sentences, count(*) AS dependencies, count(*) FILTER (WHERE relation = 'obj') AS with_object FROM dep",
    "sentiment": f"WITH {SENTIMENT} SELECT doc_id, polarity, round(score, 6) AS score, round(least(1.0, n / greatest(1, len(w)) * 4), 6) AS subjectivity, n::INT AS n_evidence FROM se",
    "sentiment_aspects": f"WITH {SENTIMENT}, a AS (SELECT polarity, unnest(list_filter([{', '.join(f'CASE WHEN list_has_any(w, {list(t)!r}) THEN {_text(a)} END' for a, t in L.ASPECTS.items())}], lambda x: x IS NOT NULL)) AS aspect FROM se) SELECT aspect, polarity, count(*) AS documents FROM a GROUP BY ALL",
    "entities_regex": f"WITH {STEPS}, e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS entity_type, unnest(regexp_extract_all(raw_text, {_text(('' if k == 'TEMPERATURE' else '(?i)') + p)})) AS text FROM steps" for k, p in L.ENTITY_PATTERNS.items()) + ") SELECT entity_type, text, count(*) AS count FROM e GROUP BY ALL",
    "silhouette": f"""WITH {POINTS}, v AS (SELECT vec_id, label, list(v ORDER BY i) AS v FROM pt GROUP BY ALL), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS t, count(*) AS n FROM v a, v b GROUP BY ALL),
      s AS (SELECT vec_id, max(CASE WHEN label = other THEN CASE WHEN n > 1 THEN t / (n - 1) ELSE -1 END END) AS a, min(CASE WHEN label <> other THEN t / n END) AS b FROM d GROUP BY vec_id)
      SELECT vec_id, round(CASE WHEN a < 0 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM s""",
    "lloyd_step": f"""WITH {POINTS}, d AS (SELECT p.vec_id, c.label, sum((p.v - c.c) ** 2) AS d FROM pt p JOIN ctr c USING (i) GROUP BY ALL), a AS (SELECT vec_id, arg_min(label, (d, label)) AS label FROM d GROUP BY vec_id)
      SELECT a.label, count(*) AS size, p.i::INT AS i, round(avg(p.v), 6) + 0.0::DOUBLE AS c FROM a JOIN pt p ON p.vec_id = a.vec_id GROUP BY a.label, p.i""",
    "vector_means": f"WITH {POINTS} SELECT p.vec_id, p.label, round(sum((p.v - c.c) ** 2), 6) AS distance2 FROM pt p JOIN ctr c ON c.label = p.label AND c.i = p.i GROUP BY ALL",
    "url_canonical": f"WITH c AS (SELECT {CANON.replace('u,', 'recipe_url,')} AS url FROM category_listings) SELECT url, count(*) AS listings, nullif(regexp_extract(url, '/receita/(\\d+)(?:[-/.?]|$)', 1), '') AS recipe_id FROM c GROUP BY url",
    "category_urls": rf"SELECT run_id, coalesce(nullif(regexp_extract({SLUG}, '^(\d+)', 1), ''), nullif({SLUG}, '')) AS category_id, CASE WHEN regexp_replace({SLUG}, '^\d+-?', '') <> '' THEN {TITLED} ELSE 'Categoria' END AS name, regexp_extract(category_url, '^([^?#]*)', 1) || '?' || array_to_string(list_append(list_filter(string_split(regexp_extract(category_url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^page(=|$)')), 'page=2'), '&') AS page_2 FROM scrape_runs",
    "parse_minutes": r"""WITH p AS (SELECT site_recipe_id AS recipe_id, nullif(regexp_extract(lower(prep_time_raw), '([0-9]+)\s*h', 1), '')::INT AS h, nullif(regexp_extract(lower(prep_time_raw), '([0-9]+)\s*(?:min|m)\b', 1), '')::INT AS m FROM recipes)
      SELECT recipe_id, CASE WHEN h IS NOT NULL OR m IS NOT NULL THEN coalesce(h, 0) * 60 + coalesce(m, 0) END AS minutes FROM p""",
    "parse_numbers": rf"""WITH p AS (SELECT site_recipe_id AS recipe_id, prep_time_raw AS x, lower(regexp_replace(prep_time_raw, '{SPACE}', '', 'g')) AS t FROM recipes)
      SELECT recipe_id, try_cast(replace(nullif(regexp_extract(x, '(\d+(?:[,.]\d+)?)', 1), ''), ',', '.') AS DOUBLE) AS rating,
      CASE WHEN t LIKE '%k' THEN floor(try_cast(replace(t[:-2], ',', '.') AS DOUBLE) * 1000)::BIGINT WHEN t LIKE '%m' THEN floor(try_cast(replace(t[:-2], ',', '.') AS DOUBLE) * 1000000)::BIGINT ELSE try_cast(nullif(regexp_replace(t, '[^0-9]', '', 'g'), '') AS BIGINT) END AS number FROM p""",
    "labels_normalized": f"SELECT {DIFF} AS difficulty, {COST} AS cost_label, count(*) AS recipes FROM recipes GROUP BY ALL",
    "changed_cells": f"""SELECT count(*) FILTER (WHERE title IS DISTINCT FROM {clean('title')}) AS title, count(*) FILTER (WHERE prep_time_raw IS DISTINCT FROM nullif({clean('prep_time_raw')}, '')) AS prep_time_raw,
      count(*) FILTER (WHERE difficulty IS DISTINCT FROM {DIFF}) AS difficulty, count(*) FILTER (WHERE cost_label IS DISTINCT FROM {COST}) AS cost_label, count(*) FILTER (WHERE url IS DISTINCT FROM {CANON.replace('u,', 'url,')}) AS url,
      count(*) FILTER (WHERE description IS DISTINCT FROM nullif({clean('description')}, '')) AS description, count(*) FILTER (WHERE origin_category IS DISTINCT FROM nullif({clean('origin_category')}, '')) AS origin_category,
      (SELECT count(*) FROM ingredients WHERE raw_text IS DISTINCT FROM nullif({clean('raw_text')}, '')) AS ingredients, (SELECT count(*) FROM preparation_steps WHERE raw_text IS DISTINCT FROM nullif({clean('raw_text')}, '')) AS preparation_steps,
      (SELECT count(*) FROM categories WHERE name IS DISTINCT FROM nullif({clean('name')}, '')) AS categories, (SELECT count(*) FROM category_listings WHERE listed_title IS DISTINCT FROM nullif({clean('listed_title')}, '')) AS category_listings FROM recipes""",
    "display_cells": r"SELECT site_recipe_id AS recipe_id, coalesce(regexp_replace(printf('%.4f', rating_value), '\.?0+$', ''), '—') AS rating, coalesce(nullif(cost_label, ''), '—') AS cost FROM recipes",
    "search_filter": f"SELECT site_recipe_id AS recipe_id, title, rating_value FROM recipes WHERE {' AND '.join(f'contains({nocase(chr(115) + chr(101) + chr(97) + chr(114) + chr(99) + chr(104) + chr(95) + chr(116) + chr(101) + chr(120) + chr(116))}, {_text(t)})' for t in ('bolo', 'chocolate', 'bol'))} AND prep_time_minutes <= 120 AND rating_value >= 3.0",
    "search_label": f"SELECT site_recipe_id AS recipe_id FROM recipes WHERE {nocase('trim(difficulty)')} = 'facil' AND {nocase('trim(cost_label)')} = 'custo alto'",
    "exists_or_exists": f"WITH {LISTED} SELECT DISTINCT site_recipe_id AS recipe_id FROM hit WHERE category_id = '2107'",
    "facet_values": f"""WITH {LISTED} SELECT DISTINCT 'difficulty' AS facet, trim(difficulty) AS value, trim(difficulty) AS label FROM recipes WHERE trim(difficulty) <> ''
      UNION ALL SELECT DISTINCT 'cost_label', trim(cost_label), trim(cost_label) FROM recipes WHERE trim(cost_label) <> '' UNION ALL SELECT 'category', site_category_id, name FROM categories WHERE trim(name) <> '' AND site_category_id IN (SELECT category_id FROM hit)""",
    "best_rated_page": f"SELECT site_recipe_id AS recipe_id, rating_value, ratings_count FROM recipes ORDER BY {ORDER} LIMIT 20 OFFSET 40",
    "notebook_filter": "SELECT site_recipe_id AS recipe_id, title FROM recipes WHERE lower(title) LIKE '%bolo%' AND difficulty = 'Fácil'",
    "first_recipe": f"""WITH r AS (SELECT * FROM recipes ORDER BY {nocase('title')}, site_recipe_id LIMIT 1), o AS (SELECT DISTINCT {clean('origin_category')} AS n FROM r WHERE trim(origin_category) <> '')
      SELECT site_recipe_id AS recipe_id, title, coalesce((SELECT string_agg(raw_text, '|' ORDER BY line_position, raw_text) FROM (SELECT DISTINCT line_position, raw_text FROM ingredients JOIN r ON recipe_id = site_recipe_id)), '') AS ingredients,
      coalesce((SELECT string_agg(raw_text, '|' ORDER BY line_position, raw_text) FROM (SELECT DISTINCT line_position, raw_text FROM preparation_steps JOIN r ON recipe_id = site_recipe_id)), '') AS steps FROM r""",
    "recipe_details": """WITH i AS (SELECT recipe_id, count(*) AS n, string_agg(raw_text, '|' ORDER BY line_position, raw_text) AS t FROM (SELECT DISTINCT recipe_id, line_position, raw_text FROM ingredients) GROUP BY recipe_id),
      s AS (SELECT recipe_id, string_agg(raw_text, '|' ORDER BY line_position, raw_text) AS t FROM (SELECT DISTINCT recipe_id, line_position, raw_text FROM preparation_steps) GROUP BY recipe_id)
      SELECT site_recipe_id AS recipe_id, coalesce(i.n, 0)::INT AS n_ingredients, coalesce(i.t, '') AS ingredients, coalesce(s.t, '') AS steps FROM recipes r LEFT JOIN i ON i.recipe_id = r.site_recipe_id LEFT JOIN s ON s.recipe_id = r.site_recipe_id""",
    "difficulty_distribution": f"SELECT {label('difficulty')} AS label, count(*) AS count FROM recipes GROUP BY 1",
    "category_distribution": f"SELECT {label('origin_category')} AS label, count(*) AS count FROM recipes GROUP BY 1",
    "title_collisions": f"SELECT {nocase('title')} AS title, count(*) AS count FROM recipes GROUP BY 1 HAVING count(*) > 1",
    "coverage_summary": """SELECT 'recipes' AS metric, count(*) AS value FROM recipes UNION ALL SELECT 'with_cost', count(*) FROM recipes WHERE trim(cost_label) <> '' UNION ALL SELECT 'with_origin', count(*) FROM recipes WHERE trim(origin_category) <> ''
      UNION ALL SELECT 'marked_duplicates', count(*) FROM recipes WHERE trim(duplicate_of_recipe_id) <> \'\' UNION ALL SELECT 'with_time', count(prep_time_minutes) FROM recipes UNION ALL SELECT 'with_rating', count(rating_value) FROM recipes
      UNION ALL SELECT 'with_ingredients', count(DISTINCT recipe_id) FROM ingredients JOIN recipes ON recipe_id = site_recipe_id UNION ALL SELECT 'with_steps', count(DISTINCT recipe_id) FROM preparation_steps JOIN recipes ON recipe_id = site_recipe_id UNION ALL SELECT 'difficulty_labels', count(DISTINCT difficulty) FROM recipes UNION ALL SELECT 'ingredients', count(*) FROM ingredients
      UNION ALL SELECT 'preparation_steps', count(*) FROM preparation_steps UNION ALL SELECT 'categories', count(*) FROM categories UNION ALL SELECT 'category_listings', count(*) FROM category_listings""",
    "latest_run": "WITH d AS (SELECT DISTINCT recipe_id, vec FROM document_embeddings WHERE vec IS NOT NULL AND run_id = (SELECT max(run_id) FROM document_embeddings)) SELECT recipe_id, round(sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM d",
    "run_counters": "SELECT r.run_id, r.status, r.listing_count, count(DISTINCT l.id) AS listings, count(DISTINCT l.recipe_id) AS listed_recipes FROM scrape_runs r LEFT JOIN category_listings l USING (run_id) GROUP BY ALL",
    "listing_upsert": "SELECT run_id, category_id, page_number, recipe_id, id, loaded_at, line_position FROM (SELECT *, row_number() OVER (PARTITION BY run_id, category_id, page_number, recipe_id ORDER BY loaded_at DESC, id DESC, line_position DESC) AS r FROM category_listings) WHERE r = 1",
    "listings_by_id_or_url": f"WITH {LISTED} SELECT site_recipe_id AS recipe_id, count(*) AS categories FROM hit GROUP BY 1",
    "category_upsert": rf"""WITH n AS (SELECT coalesce(nullif(regexp_extract({SLUG}, '^(\d+)', 1), ''), nullif({SLUG}, '')) AS id, min(CASE WHEN regexp_replace({SLUG}, '^\d+-?', '') <> '' THEN {TITLED} ELSE 'Categoria' END) AS name FROM scrape_runs GROUP BY 1),
      k AS (SELECT site_category_id AS id, min(name) AS name, min(url) AS url FROM categories GROUP BY 1) SELECT coalesce(n.id, k.id) AS site_category_id, coalesce(n.name, k.name) AS name, k.url FROM k FULL JOIN n ON n.id = k.id""",
    "origin_relations": f"""WITH l AS (SELECT site_recipe_id AS recipe_id, {folded(clean('origin_category'))} AS key FROM recipes WHERE trim(origin_category) <> ''), k AS (SELECT {folded(clean('name'))} AS key, max(site_category_id) AS id FROM categories GROUP BY 1)
      SELECT DISTINCT recipe_id, coalesce(id, 'origin:' || CASE WHEN l.key = '' THEN 'sem-nome' ELSE replace(l.key, ' ', '-') END) AS category_id, 'origin' AS relation_type FROM l LEFT JOIN k USING (key)""",
    "missing_recipes": """SELECT 'listing' AS kind, count(*) AS rows FROM category_listings WHERE recipe_id IS NOT NULL AND recipe_id NOT IN (SELECT site_recipe_id FROM recipes)
      UNION ALL SELECT 'pointer', count(*) FROM recipes WHERE duplicate_of_recipe_id IS NOT NULL AND trim(duplicate_of_recipe_id) NOT IN (SELECT site_recipe_id FROM recipes)""",
    "markup_links": "WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM documents) SELECT lower(host) AS host, count(*) AS links, count(DISTINCT doc_id) AS documents FROM u GROUP BY 1",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
