"""DuckDB SQL with the results of the core queries, written from their definitions."""

from __future__ import annotations

BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{BLANK}]+')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, ' @-@ ', '-'), ' @,@ ', ','), '[{BLANK}]+', ' ', 'g'))"


def lines(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10))"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])[{BLANK}]+', '\\1' || chr(1), 'g'), chr(1))"


def _heading(k: str) -> str:
    """Level of a line's words if it is a heading, else 0."""
    lead = f"coalesce(list_position(list_transform({k}, lambda v: v <> '='), true), 0) - 1"
    trail = f"coalesce(list_position(list_transform(list_reverse({k}), lambda v: v <> '='), true), 0) - 1"
    return f"CASE WHEN len({k}) > 0 AND {k}[1] = '=' AND {lead} > 0 AND {lead} = {trail} THEN {lead} ELSE 0 END"


_LINES = f"""
ln AS (SELECT doc_id, title, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, title, {lines('text')} AS ls FROM src)),
wd AS (SELECT *, {words('line')} AS k FROM ln),
hd AS (SELECT *, {_heading('k')} AS lv FROM wd)"""


def chunks(src: str, headings: bool = True, titled: bool = False) -> str:
    """Chunks of ``src (doc_id, title, text)``: the packing as a recursion over the units of each text."""
    level = "lv" if headings else "0"
    return f"""
WITH RECURSIVE src AS ({src}), {_LINES},
h AS (SELECT doc_id, i, {level} AS lv, array_to_string(k[lv + 1 : len(k) - lv], ' ') AS name FROM hd WHERE {level} > 0),
body AS (SELECT doc_id, title, i, {strip('line')} AS line, len(k) AS n FROM hd WHERE {level} = 0 AND len(k) > 0),
us AS (SELECT doc_id, title, i, 0 AS j, line, n, false AS ov FROM body WHERE n <= 550
  UNION ALL SELECT doc_id, title, i, j, s, len({words('s')}), true FROM (SELECT doc_id, title, i, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS j FROM (SELECT *, {sentences('line')} AS ss FROM body WHERE n > 550))),
ub AS (SELECT u.*, row_number() OVER w AS r, coalesce((SELECT max(h.i) FROM h WHERE h.doc_id = u.doc_id AND h.i < u.i), -1) AS hi,
  lag(ov, 1, false) OVER w AS was FROM us u WINDOW w AS (PARTITION BY doc_id ORDER BY i, j)),
uc AS (SELECT *, hi <> lag(hi, 1, -2) OVER (PARTITION BY doc_id ORDER BY r) OR (ov AND j = 0) OR (was AND NOT ov) AS brk FROM ub),
pk AS (SELECT doc_id, r, n AS t, 0 AS seg FROM uc WHERE r = 1
  UNION ALL SELECT u.doc_id, u.r, CASE WHEN u.brk OR p.t + u.n > 550 THEN u.n ELSE p.t + u.n END, p.seg + CASE WHEN u.brk OR p.t + u.n > 550 THEN 1 ELSE 0 END
  FROM pk p JOIN uc u ON u.doc_id = p.doc_id AND u.r = p.r + 1),
sg AS (SELECT u.doc_id, any_value(u.title) AS title, p.seg, max(u.hi) AS hi, {clean("string_agg(u.line, ' ' ORDER BY u.r)")} AS chunk_text FROM uc u JOIN pk p ON p.doc_id = u.doc_id AND p.r = u.r GROUP BY u.doc_id, p.seg),
kept AS (SELECT *, len({words('chunk_text')}) AS token_approx FROM sg WHERE len({words('chunk_text')}) >= 50),
pa AS (SELECT a.doc_id, a.i AS hi, string_agg(b.name, ' / ' ORDER BY b.i) AS path FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.i <= a.i AND b.lv > 1
  WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = b.doc_id AND c.i > b.i AND c.i <= a.i AND c.lv <= b.lv) GROUP BY a.doc_id, a.i),
ti AS (SELECT a.doc_id, a.i AS hi, (SELECT arg_max(b.name, b.i) FROM h b WHERE b.doc_id = a.doc_id AND b.i <= a.i AND b.lv = 1) AS top FROM h a),
ch AS (SELECT s.doc_id, {"coalesce(ti.top, '')" if titled else "s.title"} AS article_title, coalesce(pa.path, 'Introduction') AS section_path,
  row_number() OVER (PARTITION BY s.doc_id ORDER BY seg) - 1 AS chunk_index, chunk_text, token_approx
  FROM kept s LEFT JOIN pa ON pa.doc_id = s.doc_id AND pa.hi = s.hi LEFT JOIN ti ON ti.doc_id = s.doc_id AND ti.hi = s.hi)"""


DOCS = "SELECT doc_id, title, text FROM documents WHERE text IS NOT NULL"
ESSAYS = "SELECT essay_id AS doc_id, essay_title AS title, essay_content AS text FROM essay WHERE essay_content IS NOT NULL"
CHUNK_COLUMNS = "doc_id, article_title, section_path, chunk_index, chunk_text, token_approx"

_FACTS = f"""
fx AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {strip('subject')} AS subject, {strip('relation')} AS relation, {strip('object')} AS object
  FROM (SELECT DISTINCT doc_id, pos, subject, relation, object FROM triples) WHERE doc_id IS NOT NULL),
facts AS (SELECT * FROM fx WHERE subject <> '' AND relation <> '' AND object <> ''),
dd AS (SELECT doc_id, min(pos) AS pos, subject, relation, object FROM facts GROUP BY doc_id, subject, relation, object)"""
_NAMES = "nm AS (SELECT doc_id, subject AS name FROM facts UNION SELECT doc_id, object FROM facts)"
_DEFINED = f"""
dx AS (SELECT doc_id, {strip('relation')} AS relation, {strip('definition')} AS definition, ord FROM relations WHERE doc_id IS NOT NULL),
defs AS (SELECT doc_id, relation, max(definition) AS definition, min(ord) AS ord FROM dx WHERE relation <> '' AND definition <> '' GROUP BY doc_id, relation)"""
_CONCEPTS = f"""
cx AS (SELECT doc_id, {strip('name')} AS name, list_filter(list_transform(concepts, lambda c: {strip('c')}), lambda c: c <> '') AS concepts FROM nodes WHERE doc_id IS NOT NULL),
con AS (SELECT doc_id, name, max(concepts) AS concepts FROM cx WHERE name <> '' AND len(concepts) > 0 GROUP BY doc_id, name)"""
_NODES = f"{_FACTS}, {_NAMES}, {_CONCEPTS}, nd AS (SELECT doc_id, name, coalesce(con.concepts, []) AS concepts FROM nm LEFT JOIN con USING (doc_id, name))"
_ORDERED_WORDS = f"list_filter(list_transform({words('lower(relation)')}, lambda w, i: CASE WHEN length(w) >= 4 AND list_position({words('lower(relation)')}, w) = i THEN w END), lambda w: w IS NOT NULL)"
_RELATIONS = f"""{_DEFINED}, rl AS (SELECT DISTINCT doc_id, relation FROM facts),
rt AS (SELECT doc_id, relation, coalesce(defs.definition, '') AS definition, CASE WHEN defs.definition IS NULL THEN [] ELSE {_ORDERED_WORDS} END AS concepts FROM rl LEFT JOIN defs USING (doc_id, relation))"""
_CONTEXT = """
cn AS (SELECT doc_id, subject AS name, pos, subject, relation, object FROM dd UNION ALL SELECT doc_id, object, pos, subject, relation, object FROM dd WHERE object <> subject),
cr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos, subject, relation, object) AS rank FROM cn QUALIFY rank <= 3)"""


def _map(column: str) -> str:
    return f"""mp AS (SELECT doc_id, e.key AS variant, min(e.value) AS canonical FROM (SELECT doc_id, unnest(map_entries({column})) AS e FROM kg WHERE doc_id IS NOT NULL)
  WHERE e.value <> '' GROUP BY doc_id, e.key)"""


def _candidates(kind: str, least: float = 0.8) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT doc_id, name || '#' || vec_id AS name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, vec_id) AS ord, CAST(vec AS DOUBLE[]) AS vec
  FROM name_vectors WHERE kind = '{kind}' AND doc_id IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM v WHERE vec IS NOT NULL AND list_dot_product(vec, vec) > 0),
p AS (SELECT a.doc_id, a.name AS target, b.name AS candidate, a.ord AS x, b.ord AS y, list_dot_product(a.vec, b.vec) / (a.n * b.n) AS score FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.ord <> b.ord)
SELECT doc_id, target, candidate, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id, x ORDER BY score DESC, y) AS rank FROM p WHERE score >= {least} QUALIFY rank <= 5"""


def _fold(kind: str, least: float, match: float) -> str:
    """The fold over an article's names in their order, as a recursion whose state are the mapping, the names that are done and the singletons."""
    return f"""{_candidates(kind, least).replace("SELECT doc_id, target", ", ca AS (SELECT doc_id, target").rstrip()}),
n AS (SELECT doc_id, list(name ORDER BY ord) AS names FROM v GROUP BY doc_id HAVING count(*) > 1),
an AS (SELECT doc_id, target, coalesce(list(candidate ORDER BY rank) FILTER (score >= {match}), []) AS m FROM ca GROUP BY doc_id, target),
aw AS (SELECT *, list_reduce([target] || m, lambda a, b: CASE WHEN length(b) > length(a) OR (length(b) = length(a) AND b > a) THEN b ELSE a END) AS proposed FROM an),
f AS (SELECT doc_id, names, 0 AS i, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS canon, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS single FROM n
  UNION ALL SELECT doc_id, names, i + 1,
    CASE WHEN skip OR (m IS NULL AND ({kind == 'relation'} OR canon[t] IS NOT NULL)) THEN canon WHEN m IS NULL THEN map_concat(canon, MAP {{t: t}})
      ELSE map_concat(canon, map_from_entries(list_transform(g, lambda x: struct_pack(k := x, v := coalesce(nullif(list_filter(list_transform(g, lambda y: canon[y]), lambda y: y IS NOT NULL)[1], ''), proposed))))) END,
    CASE WHEN skip OR m IS NULL THEN done ELSE done || m END, CASE WHEN m IS NULL AND NOT skip THEN single || [t] ELSE single END
  FROM (SELECT f.*, names[i + 1] AS t, list_contains(done, names[i + 1]) AS skip, aw.m, aw.proposed, list_filter([names[i + 1]] || list_filter(aw.m, lambda x: x <> names[i + 1]), lambda x: list_contains(names, x)) AS g
    FROM f LEFT JOIN aw ON aw.doc_id = f.doc_id AND aw.target = names[i + 1] WHERE i < len(names)) s),
e AS (SELECT doc_id, canon, single, unnest(names) AS variant FROM f WHERE i = len(names))"""


_ASKED = "(SELECT DISTINCT doc_id, subject AS name FROM facts)"
_EXAMPLES = """
ex AS (SELECT doc_id, relation, count(*) AS frequency, min(struct_pack(pos := pos, s := subject, o := object)) AS f FROM dd GROUP BY doc_id, relation),
eo AS (SELECT doc_id, relation, row_number() OVER (PARTITION BY doc_id ORDER BY f.pos, relation) - 1 AS ord, frequency, f.s AS subject, f.o AS object FROM ex)"""
_FREQUENCY = """
fq AS (SELECT doc_id, relation, coalesce(frequency, 0) AS frequency, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(frequency, 0) DESC, defs.ord, relation) - 1 AS ord FROM defs LEFT JOIN eo USING (doc_id, relation))"""

_TITLES = "ti AS (SELECT doc_id, coalesce(max(article_title), '') AS title FROM kg WHERE doc_id IS NOT NULL GROUP BY doc_id)"


def _asked(size: int, opening: str, line: str) -> str:
    return f"""
WITH {_FACTS}, {_EXAMPLES}, {_DEFINED}, {_TITLES},
l AS (SELECT eo.doc_id, eo.ord, eo.ord // {size} AS batch, {line} AS line FROM eo LEFT JOIN defs ON defs.doc_id = eo.doc_id AND defs.relation = eo.relation)
SELECT doc_id, batch, 'Article: ' || any_value(title) || chr(10) || '{opening}' || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS prompt FROM l JOIN ti USING (doc_id) GROUP BY doc_id, batch"""


_EXAMPLE = "' e.g. (' || eo.subject || ', ' || eo.relation || ', ' || eo.object || ')'"

SQL: dict[str, str] = {
    "definition_prompts": _asked(10, "Define:", f"""'- "' || eo.relation || '"' || {_EXAMPLE}"""),
    "singleton_prompts": _asked(8, "Shorten where needed, leave none out:", f"""'- "' || eo.relation || '"' || {_EXAMPLE}"""),
    "relation_kind_prompts": _asked(8, "Relations:", f"""'"' || eo.relation || '": ' || coalesce(definition, '') || {_EXAMPLE}"""),
    "relation_strings": f"WITH {_DEFINED} SELECT doc_id, relation, relation || ' ' || definition AS embedded FROM defs",
    "entity_prompts": f"""
WITH {_FACTS}, {_CONTEXT}, {_TITLES},
n AS (SELECT doc_id, name, left(name, 1) AS letter, string_agg('(' || subject || ', ' || relation || ', ' || object || ')', ' | ' ORDER BY rank) AS told FROM cr GROUP BY doc_id, name),
p AS (SELECT a.doc_id, a.name, a.told, b.name AS other, b.told AS other_told FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.letter = b.letter AND a.name <> b.name QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.name ORDER BY b.name) <= 5)
SELECT doc_id, name, 'Article: ' || any_value(title) || chr(10) || 'Name: "' || name || '" in ' || any_value(told) || chr(10) || 'Which of these mean the same?' || chr(10)
  || string_agg('- "' || other || '" in ' || other_told, chr(10) ORDER BY other) AS prompt FROM p JOIN ti USING (doc_id) GROUP BY doc_id, name""",
    "token_count": f"SELECT doc_id, CAST(coalesce(len({words('text')}), 0) AS BIGINT) AS n_tokens FROM documents",
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "heading_parse": f"WITH src AS ({DOCS}), {_LINES} SELECT doc_id, CAST(i AS BIGINT) AS line_index, CAST(lv AS BIGINT) AS level, array_to_string(k[lv + 1 : len(k) - lv], ' ') AS name FROM hd WHERE lv > 0",
    "sentence_split": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS k, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "section_chunks": chunks(DOCS) + f" SELECT {CHUNK_COLUMNS} FROM ch",
    "file_chunks": chunks(DOCS, titled=True) + f" SELECT {CHUNK_COLUMNS} FROM ch",
    "stream_chunks": chunks(DOCS) + " SELECT doc_id, chunk_index, token_approx FROM ch",
    "packed_chunks": chunks(ESSAYS, headings=False) + f" SELECT {CHUNK_COLUMNS} FROM ch",
    "paragraph_chunks": rf"""
WITH src AS ({ESSAYS}), p AS (SELECT doc_id, title, list_filter(list_transform(string_split(regexp_replace({strip('text')}, '\r\n?', chr(10), 'g'), chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM src)
SELECT doc_id, title AS article_title, 'paragraph' AS section_path, generate_subscripts(ps, 1) - 1 AS chunk_index, unnest(ps) AS chunk_text, len({words('unnest(ps)')}) AS token_approx FROM p""",
    "whole_chunks": f"""
WITH src AS ({ESSAYS}), c AS (SELECT doc_id, title, {clean('text')} AS t FROM src)
SELECT doc_id, title AS article_title, 'full_article' AS section_path, CAST(0 AS BIGINT) AS chunk_index, t AS chunk_text, len({words('t')}) AS token_approx FROM c WHERE len({words('t')}) >= 50""",
    "sampler": rf"""
WITH a AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n( = [^=])', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents),
p AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos, unnest(s) AS x FROM a)
SELECT doc_id, pos, {strip('x')} AS article FROM p WHERE length({strip('x')}) > 2000 ORDER BY doc_id, pos LIMIT 5""",
    "corpus_sampler": rf"""
WITH c AS (SELECT string_agg(coalesce(regexp_replace(text, '\r\n?', chr(10), 'g'), ''), chr(10) ORDER BY doc_id) AS t FROM documents),
a AS (SELECT string_split(regexp_replace(t, '\n( = [^=])', chr(1) || '\1', 'g'), chr(1)) AS s FROM c),
p AS (SELECT generate_subscripts(s, 1) AS pos, unnest(s) AS x FROM a)
SELECT {strip('x')} AS article FROM p WHERE length({strip('x')}) > 2000 ORDER BY pos LIMIT 5""",
    "resume_anti": "SELECT doc_id, title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kg WHERE doc_id IS NOT NULL)",
    "rule_triples": f"""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, chunk_index, chunk_text FROM chunks WHERE chunk_text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, chunk_index, chunk_id, generate_subscripts(ss, 1) AS k, unnest(ss) AS x FROM (SELECT *, {sentences('chunk_text')} AS ss FROM c)),
w AS (SELECT *, {words('x')} AS w FROM s),
t AS (SELECT doc_id, chunk_index, chunk_id, k, w[1] AS subject, w[2] AS relation, regexp_replace(array_to_string(w[3:], ' '), '[.!?]+$', '') AS object FROM w WHERE len(w) >= 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, chunk_id, k) - 1 AS pos, subject, relation, object FROM t WHERE object <> ''""",
    "validate_triples": f"WITH {_FACTS} SELECT * FROM facts",
    "answered_triples": f"""
WITH t AS (SELECT DISTINCT doc_id, triple_id, subject, relation, object FROM triples WHERE doc_id IS NOT NULL),
v AS (SELECT doc_id, triple_id, {strip('subject')} AS subject, {strip('relation')} AS relation, {strip('object')} AS object FROM t)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY triple_id) - 1 AS pos, subject, relation, object FROM v WHERE subject <> '' AND relation <> '' AND object <> ''""",
    "dedup_triples": f"WITH {_FACTS} SELECT doc_id, pos, subject, relation, object FROM dd",
    "dedup_stats": f"""
WITH {_FACTS}, a AS (SELECT doc_id, count(*) AS n_in FROM facts GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n_out FROM dd GROUP BY doc_id)
SELECT doc_id, n_in, n_out, n_in - n_out AS n_removed FROM a JOIN b USING (doc_id)""",
    "context_triples": f"WITH {_FACTS}, {_CONTEXT} SELECT doc_id, name, rank, pos, subject, relation, object FROM cr",
    "embed_strings": f"""
WITH {_FACTS}, {_CONTEXT} SELECT doc_id, name, name || ' ' || string_agg('(' || subject || ', ' || relation || ', ' || object || ')', ' | ' ORDER BY rank) AS embedded FROM cr GROUP BY doc_id, name""",
    "extract_prompts": """
SELECT chunk_id, 'Article: ' || coalesce(article_title, '') || chr(10) || 'Section: ' || coalesce(section_path, '') || chr(10) || 'Text:' || chr(10) || coalesce(chunk_text, '') AS prompt
FROM (SELECT DISTINCT chunk_id, article_title, section_path, chunk_text FROM chunks)""",
    "relation_examples": f"WITH {_FACTS}, {_EXAMPLES} SELECT doc_id, relation, ord, frequency, subject, object FROM eo",
    "relation_order": f"WITH {_FACTS}, {_EXAMPLES}, {_DEFINED}, {_FREQUENCY} SELECT doc_id, relation, frequency, ord FROM fq",
    "entity_batches": f"""
WITH {_FACTS}, o AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) - 1 AS ord FROM {_ASKED})
SELECT doc_id, name, ord, ord // 8 AS batch FROM o""",
    "entity_candidates": _candidates("entity"),
    "relation_candidates": _candidates("relation", 0.3),
    "entity_map_fold": _fold("entity", 0.8, 0.9) + " SELECT doc_id, variant, coalesce(canon[variant], variant) AS canonical FROM e",
    "relation_map_fold": _fold("relation", 0.3, 0.32)
    + " SELECT doc_id, variant, CASE WHEN list_contains(single, variant) THEN split_part(variant, '#', 1) ELSE coalesce(canon[variant], variant) END AS canonical FROM e",
    "apply_entity_map": f"""
WITH {_FACTS}, {_map('entity_map')}
SELECT f.doc_id, f.pos, coalesce(a.canonical, f.subject) AS subject, f.relation, coalesce(b.canonical, f.object) AS object
FROM facts f LEFT JOIN mp a ON a.doc_id = f.doc_id AND a.variant = f.subject LEFT JOIN mp b ON b.doc_id = f.doc_id AND b.variant = f.object""",
    "apply_relation_map": f"""
WITH {_FACTS}, {_map('relation_map')}
SELECT f.doc_id, f.pos, f.subject, coalesce(a.canonical, f.relation) AS relation, f.object FROM facts f LEFT JOIN mp a ON a.doc_id = f.doc_id AND a.variant = f.relation""",
    "merge_stats": f"WITH {_map('entity_map')} SELECT doc_id, count(*) AS n_names, count(*) FILTER (variant <> canonical) AS n_merged FROM mp GROUP BY doc_id",
    "definition_answers": f"""
WITH {_FACTS}, {_EXAMPLES}, {_DEFINED}, {_FREQUENCY},
tx AS (SELECT doc_id, {strip('relation')} AS relation, max(definition) AS definition FROM relations WHERE definition IS NOT NULL GROUP BY ALL)
SELECT doc_id, relation, {strip('definition')} AS definition, ord FROM (SELECT fq.doc_id, fq.relation, tx.definition, fq.ord FROM fq JOIN tx ON tx.doc_id = fq.doc_id AND tx.relation = fq.relation) WHERE {strip('definition')} <> ''""",
    "concept_answers": f"""
WITH {_FACTS}, tx AS (SELECT doc_id, name, max(concepts) AS concepts FROM nodes WHERE concepts IS NOT NULL AND name IS NOT NULL GROUP BY doc_id, name),
c AS (SELECT doc_id, name, list_filter(list_transform(concepts, lambda c: {strip('c')}), lambda c: c <> '') AS concepts FROM {_ASKED} JOIN tx USING (doc_id, name))
SELECT * FROM c WHERE len(concepts) > 0""",
    "graph_nodes": f"WITH {_NODES} SELECT doc_id, name, concepts FROM nd",
    "graph_relations": f"WITH {_FACTS}, {_RELATIONS} SELECT doc_id, relation, definition, concepts FROM rt",
    "kg_counts": f"""
WITH {_FACTS}, {_NAMES}, n AS (SELECT doc_id, count(*) AS n_nodes FROM nm GROUP BY doc_id)
SELECT doc_id, n_nodes, count(DISTINCT relation) AS n_relations, count(*) AS n_triples FROM facts JOIN n USING (doc_id) GROUP BY doc_id, n_nodes""",
    "concept_triples": f"""
WITH {_NODES}, {_RELATIONS} SELECT doc_id, name AS subject, 'type' AS relation, unnest(concepts) AS object FROM nd
UNION ALL SELECT doc_id, relation, 'category', unnest(concepts) FROM rt""",
    "property_nodes": f"""
WITH {_NODES}, l AS (SELECT CASE WHEN len(concepts) > 0 THEN 'Entity' ELSE 'Literal' END AS label, name, doc_id, concepts FROM nd)
SELECT label, name, arg_max(concepts, doc_id) AS concepts FROM l GROUP BY label, name""",
    "property_edges": f"""
WITH {_FACTS}, {_RELATIONS}, e AS (SELECT subject AS src, upper(replace(translate(relation, ' -/', '___'), '''', '')) AS rel_type, object AS dst, doc_id, pos, relation, definition, concepts FROM facts JOIN rt USING (doc_id, relation))
SELECT src, rel_type, dst, l.relation AS relation_name, l.definition AS definition, l.concepts AS concepts
FROM (SELECT src, rel_type, dst, max(struct_pack(doc_id := doc_id, pos := pos, relation := relation, definition := definition, concepts := concepts)) AS l FROM e GROUP BY src, rel_type, dst)""",
    "has_entity": f"WITH {_NODES} SELECT doc_id, name FROM nd WHERE len(concepts) > 0",
    "kg_documents": f"""
WITH {_NODES}, {_DEFINED}, rl AS (SELECT DISTINCT doc_id, relation FROM facts), {_map('entity_map').replace('mp AS', 'em AS')}, {_map('relation_map').replace('mp AS', 'rm AS')},
ti AS (SELECT doc_id, max(article_title) AS article_title FROM kg WHERE doc_id IN (SELECT doc_id FROM facts) GROUP BY doc_id),
p AS (SELECT doc_id, 'node' AS part, name AS key, array_to_string(concepts, '|') AS value FROM nd
  UNION ALL SELECT doc_id, 'relation', relation, coalesce(definition, '') || '|' FROM rl LEFT JOIN defs USING (doc_id, relation)
  UNION ALL SELECT doc_id, 'triple', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, subject, relation, object) - 1 AS VARCHAR), concat_ws('|', subject, relation, object) FROM dd
  UNION ALL SELECT doc_id, 'entity_map', variant, canonical FROM em UNION ALL SELECT doc_id, 'relation_map', variant, canonical FROM rm)
SELECT doc_id, article_title, part, key, value FROM p JOIN ti USING (doc_id)""",
    "wiki_records": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, title, text FROM documents",
    "essay_records": "SELECT essay_title AS doc_id, essay_title AS title, essay_content AS text FROM essay",
    "article_files": r"""
SELECT 'essay_' || essay_id || '.v1' AS doc_id, 'essay_' || essay_id || '.v1' AS title, regexp_replace(max(essay_content), '\r\n?', chr(10), 'g') || chr(10) AS text FROM essay WHERE essay_content IS NOT NULL GROUP BY essay_id""",
    "graph_lines": f"""
WITH {_FACTS}, ti AS (SELECT doc_id, max(article_title) AS article_title FROM kg GROUP BY doc_id)
SELECT article_title, row_number() OVER (PARTITION BY doc_id ORDER BY pos, subject, relation, object) - 1 AS place, subject, relation, object FROM dd JOIN ti USING (doc_id)""",
    "graph_files": f"""
WITH {_FACTS}, ti AS (SELECT doc_id, max(article_title) AS article_title FROM kg WHERE doc_id IN (SELECT doc_id FROM facts) GROUP BY doc_id),
la AS (SELECT max(doc_id) AS doc_id FROM ti GROUP BY translate(coalesce(article_title, ''), ' /', '__'))
SELECT article_title, subject, relation, object FROM dd JOIN ti USING (doc_id) JOIN la USING (doc_id) UNION ALL SELECT 'broken.json', '', '', ''""",
    "progress_keys": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id IN (SELECT doc_id FROM kg WHERE doc_id IS NOT NULL) AS done FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM kg WHERE doc_id IS NOT NULL)",
    "pipeline_status": chunks("SELECT essay_id AS doc_id, (max(struct_pack(t := essay_title, c := essay_content))).t AS title, (max(struct_pack(t := essay_title, c := essay_content))).c AS text FROM essay GROUP BY essay_id", headings=False)
    + f""", r AS (SELECT essay_id AS doc_id, max(essay_title) AS title FROM essay GROUP BY essay_id),
w AS (SELECT doc_id, {words("unnest(" + sentences("chunk_text") + ")")} AS w FROM ch),
t AS (SELECT DISTINCT doc_id, w[1] AS s, w[2] AS r, array_to_string(w[3:], ' ') AS o FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS nodes FROM (SELECT doc_id, s FROM t UNION SELECT doc_id, o FROM t) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT r) AS relations, count(*) AS triples FROM t GROUP BY doc_id),
a AS (SELECT DISTINCT doc_id FROM ch)
SELECT r.doc_id, r.title AS article, coalesce(nodes, 0) AS nodes, coalesce(relations, 0) AS relations, coalesce(triples, 0) AS triples,
  CASE WHEN a.doc_id IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN a.doc_id IS NULL THEN 'no chunks' END AS error
FROM r LEFT JOIN a USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    # the ladder of repairs: the first text that is valid decides; a loose comma makes a text invalid, whatever the engine's own view of it
    "json_answers": r"""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, chunk_index, chunk_text FROM chunks WHERE chunk_text IS NOT NULL AND doc_id IS NOT NULL),
j AS (SELECT chunk_id, CAST(to_json(struct_pack(a := chunk_text)) AS VARCHAR) AS j FROM c),
x AS (SELECT chunk_id, unnest([struct_pack(form := 'fenced', raw := '```json' || chr(10) || '[' || j || ']' || chr(10) || '```'), struct_pack(form := 'prose', raw := 'Sure: [' || j || '] I hope so.'),
  struct_pack(form := 'comma', raw := '[' || j || ', ,]'), struct_pack(form := 'two', raw := '[' || j || '] [2]'), struct_pack(form := 'object', raw := j)]) AS f FROM j),
u AS (SELECT chunk_id, f.form AS form, regexp_replace(regexp_replace(f.raw, '^```(json)?\s*', ''), '\s*```$', '') AS t FROM x),
b AS (SELECT *, regexp_extract(t, '(?s)\{.*\}|\[.*\]') AS block FROM u),
l AS (SELECT chunk_id, form, list_filter([t, block, regexp_replace(block, '(,\s*)+([}\]])', '\2', 'g'), regexp_replace(t, '(,\s*)+([}\]])', '\2', 'g')], lambda v: json_valid(v)) AS good FROM b)
SELECT chunk_id, form, coalesce(json_type(good[1]) = 'ARRAY', false) AS parsed FROM l""",
}
