"""DuckDB SQL for the rows of the queries that SQL can express: op2, op3, op10 and op12."""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of three-word shingles, links by counts of common ones, the smallest id within reach.
OP2 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS class_id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT class_id, n, unnest(s) AS x FROM classes),
links AS (SELECT a.class_id AS a, b.class_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT class_id AS node, class_id AS other FROM classes UNION SELECT node, b FROM reach JOIN links ON other = a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN roots ON node = class_id
"""

#: Windows of items and of documents, for each length that a window has.
OP3 = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, x)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY 1),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Lines by their words: an earlier equal one, or one within one word's edit where both have five words or more.
OP10 = """
WITH lines AS (SELECT doc_id, i AS line_no, list_filter(string_split(lower(line), ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
firsts AS (SELECT w, len(w) AS n, min((doc_id, line_no)) AS place FROM lines WHERE len(w) > 0 GROUP BY w),
cuts AS (SELECT place, n, j, list_concat(w[1:j - 1], w[j + 1:]) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM firsts WHERE n >= 5)),
near AS (SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, j, v) AS of FROM cuts) WHERE of < place
  UNION SELECT greatest(c.place, f.place) FROM cuts c JOIN firsts f ON c.v = f.w AND f.n = c.n - 1 WHERE f.n >= 5),
dropped AS (SELECT doc_id, line_no FROM lines l JOIN firsts f ON l.w = f.w WHERE (l.doc_id, l.line_no) <> f.place OR f.place IN (SELECT place FROM near))
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, count(line_no) AS n_dropped, coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no), '') AS dropped
FROM documents LEFT JOIN dropped USING (doc_id) WHERE text IS NOT NULL GROUP BY doc_id, text
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds written out: each assigns every part to its nearest entry and floors the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select p.vec_id, p.label, p.part, p.v, arg_min(b.entry, b.d) as entry, min(b.d // {entries}) as d from p, lateral (
  select entry, {entries} * list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::bigint + entry as d from b{r} c where c.part = p.part) b group by all)""")
        if r < rounds:
            steps.append(f"""m{r} as (select part, entry, i, sum(x)::bigint as s, count(*) as n from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by all),
b{r + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join (
  select part, entry, list((s - ((s % n) + n) % n) // n order by i) as v from m{r} group by all) m on m.part = b.part and m.entry = b.entry)""")
    return f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, part, w[part * (len(w) // {parts}) + 1 : (part + 1) * (len(w) // {parts})] as v from kept, range({parts}) r(part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from p where vec_id in (select vec_id from kept order by vec_id limit {entries})),
{", ".join(steps)},
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds}),
rows as (select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from rows, books"""


OP12 = _vector_codes()
