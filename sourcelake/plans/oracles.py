"""SQL that recomputes each benchmark query from the relational tables.

Only the block trees parse rendered code: names, imports and edges come from the keys
the corpus was rendered from (see ``corpus``).  The similarity queries compare
whole line sets and cluster one vertex at a time.
"""

from __future__ import annotations

from sourcelake.operators.code_trees import JS_KEYWORDS, PY_KEYWORDS
from sourcelake.plans import corpus

# The wording of summaries, prompts, context and documents in this module.
THRESHOLD = 0.85
STAMP = "2024-01-01T00:00:00Z"
VERSION = "sourcelake-1"
LEAF = "Leaf dependency with no internal imports."



def _text(template: str) -> str:
    return "'" + template.replace("'", "''") + "'"


def _filled(template: str) -> str:
    """SQL for a template of the corpus with its places taken by columns; ``k`` last, as they hold it too."""
    sql = _text(template)
    for name in ("imports", "wide", "extra"):
        sql = f"replace({sql}, '{{{name}}}', {name})"
    return f"replace({sql}, '{{k}}', CAST(k AS VARCHAR))"


CTE = {
    # -- rendered code ---------------------------------------------------------
    "ord": """SELECT o_orderkey AS k, 'repo_' || (o_orderkey % 4) AS repo,
        'orders/order_' || o_orderkey || CASE o_orderkey % 4 WHEN 1 THEN '.ts' WHEN 3 THEN '.js' ELSE '.py' END AS path,
        o_orderdate FROM orders""",
    "prt": """SELECT p_partkey AS k, 'repo_' || (p_partkey % 4) AS repo,
        unnest(CASE WHEN p_partkey % 16 = 0 THEN ['.py', '/__init__.py', '.ts']
                    WHEN p_partkey % 8 < 4 THEN ['.py', '.ts'] ELSE ['/__init__.py', '/index.js'] END) AS suffix
        FROM part""",
    "prt_file": "SELECT k, repo, 'parts/part_' || k || suffix AS path, suffix FROM prt",
    "code": """SELECT repo, path, k, epoch(o_orderdate::DATE)::BIGINT AS seconds, 'order' AS what FROM ord
        UNION ALL SELECT repo, path, k, 946684800, 'part' FROM prt_file""",
    "item": """SELECT l_orderkey AS k, l_partkey AS p,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem""",
    "n_item": "SELECT o.k, count(i.k) AS n FROM ord o LEFT JOIN item i ON o.k = i.k GROUP BY o.k",
    "imp": """SELECT o.repo, o.path, o.k, i.pos::BIGINT AS pos,
            CASE o.k % 4 WHEN 1 THEN 'import { Item } from "../parts/part_' || i.p || '";'
                WHEN 3 THEN 'require:../parts/part_' || i.p ELSE 'from parts.part_' || i.p || ' import Item' END AS text,
            CASE WHEN i.p % 4 <> o.k % 4 THEN NULL
                WHEN o.k % 2 = 0 THEN 'parts/part_' || i.p || CASE WHEN i.p % 8 < 4 THEN '.py' ELSE '/__init__.py' END
                ELSE 'parts/part_' || i.p || CASE WHEN i.p % 8 < 4 THEN '.ts' ELSE '/index.js' END END AS dst
        FROM ord o JOIN item i ON o.k = i.k
        UNION ALL
        SELECT o.repo, o.path, o.k, n, CASE o.k % 4 WHEN 1 THEN 'import fs from "fs";' WHEN 3 THEN 'require:fs'
            ELSE 'import os' END, NULL FROM ord o JOIN n_item USING (k)
        UNION ALL
        SELECT o.repo, o.path, o.k, n + 1, 'from tools import (  # several' || chr(10) || '    first,' || chr(10)
            || '    second,' || chr(10) || ')', NULL FROM ord o JOIN n_item USING (k) WHERE o.k % 2 = 0 AND o.k % 5 = 0
        UNION ALL
        SELECT o.repo, o.path, o.k, n + 1 + CASE WHEN o.k % 5 = 0 THEN 1 ELSE 0 END, 'import json', NULL
            FROM ord o JOIN n_item USING (k) WHERE o.k % 2 = 0 AND o.k % 3 = 0""",
    "fn": """SELECT repo, path, 'functions' AS kind, 0 AS pos, 'total' AS name FROM ord WHERE k % 2 = 0
        UNION ALL SELECT repo, path, 'functions', 1, 'load_' || k FROM ord WHERE k % 2 = 0
        UNION ALL SELECT repo, path, 'functions', 2, 'extra_' || k FROM ord WHERE k % 6 = 0
        UNION ALL SELECT repo, path, 'functions', 0, 'load' || k FROM ord WHERE k % 2 = 1
        UNION ALL SELECT repo, path, 'functions', 0, 'price' FROM prt_file WHERE suffix IN ('.py', '/__init__.py')""",
    "cls": """SELECT repo, path, 'classes' AS kind, 0 AS pos, 'Order' || k AS name FROM ord
        UNION ALL SELECT repo, path, 'classes', 0, 'Item' FROM prt_file""",
    "exported": """SELECT repo, path, 'exports' AS kind, 0 AS pos, 'export interface Line' || k || ' { id: number }' AS name
            FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'exports', 1, 'export type Key' || k || ' = string;' FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'exports', 2, 'export enum Status' || k || ' { Open, Closed }' FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'exports', 3, 'export class Order' || k || ' {' FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'exports', 4, 'export function load' || k || '(key: Key' || k || '): Key' || k || ' {' FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'exports', 0, 'export class Item {' FROM prt_file WHERE suffix = '.ts'""",
    "ts_types": """SELECT repo, path, 'interfaces' AS kind, 0 AS pos, 'Line' || k AS name FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'types', 0, 'Key' || k FROM ord WHERE k % 4 = 1
        UNION ALL SELECT repo, path, 'enums', 0, 'Status' || k FROM ord WHERE k % 4 = 1""",
    "mention": """SELECT repo, path, coalesce(string_agg(m, ', ' ORDER BY pos) FILTER (WHERE m IS NOT NULL), '') AS mentions
        FROM (SELECT c.repo, c.path, i.pos, CASE
                WHEN i.text LIKE 'require:%' THEN split_part(i.text, '/', -1)
                WHEN i.text LIKE 'import {%' THEN split_part(i.text, '/', -1)
                WHEN i.text = 'import fs from "fs";' THEN 'fs";'
                WHEN i.text IN ('import os', 'import json') THEN i.text[8:] END AS m
              FROM code c LEFT JOIN imp i ON c.repo = i.repo AND c.path = i.path) GROUP BY repo, path""",
    "summary": f"""SELECT c.repo, c.path, c.k, c.what, c.seconds,
            c.repo || '|' || c.path || '|' || c.seconds || '|{VERSION}' AS key,
            'Module ' || regexp_replace(split_part(c.path, '/', -1), '\\.[a-z]+$', '') || ' with '
            || coalesce(f.n, 0) || ' functions, 1 classes.'
            || CASE WHEN i.n IS NULL THEN ' {LEAF}'
                    WHEN m.mentions <> '' THEN ' Depends on: ' || replace(replace(m.mentions, 'require:', ''), '.js', '') || '.'
                    ELSE '' END AS summary
        FROM code c
        LEFT JOIN (SELECT repo, path, count(*) AS n FROM fn GROUP BY ALL) f ON c.repo = f.repo AND c.path = f.path
        LEFT JOIN (SELECT repo, path, count(*) AS n FROM imp GROUP BY ALL) i ON c.repo = i.repo AND c.path = i.path
        LEFT JOIN mention m ON c.repo = m.repo AND c.path = m.path""",
    "seed": """SELECT key, k, CASE WHEN k % 9 = 0 THEN '' ELSE 'cached ' || k END AS cached FROM summary
        WHERE what = 'order' AND k % 3 = 0""",
    # -- scattered paths -------------------------------------------------------
    "scattered": """SELECT k, repo, place, suffix, CASE place
            WHEN 0 THEN 'tests/' || name WHEN 1 THEN 'node_modules/' || name WHEN 2 THEN 'build/' || name
            WHEN 3 THEN 'orders/order_' || k || upper(suffix) WHEN 4 THEN 'orders/' || k || '/poetry.lock'
            WHEN 5 THEN 'Spec/' || name WHEN 6 THEN 'orders/test_' || name WHEN 7 THEN 'temp/keep_' || k || suffix
            WHEN 8 THEN 'x/keep_' || k || suffix WHEN 9 THEN 'a/__pycache__/' || name
            WHEN 10 THEN 'gen_' || (k % 2) || '/' || name WHEN 11 THEN 'dist/' || name
            WHEN 12 THEN 'deep/a/b/out/' || name WHEN 13 THEN 'orders/order_' || k || '.spec' || suffix
            WHEN 14 THEN 'logs/' || name ELSE 'orders/' || name END AS path
        FROM (SELECT k, repo, (k // 4) % 20 AS place, split_part(path, '/', -1) AS name,
                CASE k % 4 WHEN 1 THEN '.ts' WHEN 3 THEN '.js' ELSE '.py' END AS suffix FROM ord)""",
    # -- documents as files ----------------------------------------------------
    "doc": """SELECT lang AS repo, 'docs/doc_' || doc_id || '.py' AS path, doc_id, doc_id // 2 AS t,
            CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'from docs.doc_' || (doc_id // 2) || ' import body'
                ELSE 'import docs.doc_' || (doc_id // 2) END AS stmt, text FROM documents""",
    "doc_content": """SELECT repo, path, doc_id, stmt, CASE WHEN stmt = '' THEN '' ELSE stmt || chr(10) END || '# '
            || replace(text, chr(10), chr(10) || '# ') AS content FROM doc""",
    "doc_edge": """SELECT a.repo, a.path AS src, b.path AS dst FROM doc a JOIN doc b ON a.t = b.doc_id AND a.repo = b.repo
        WHERE a.stmt <> ''""",
    "doc_graph": """SELECT d.repo, d.path, d.doc_id, d.stmt, e.dst FROM doc d
        LEFT JOIN doc_edge e ON d.repo = e.repo AND d.path = e.src""",
    "doc_summary": f"""SELECT repo, path, 'Module doc_' || doc_id || ' with 0 functions, 0 classes.' || CASE
            WHEN stmt = '' THEN ' {LEAF}' WHEN stmt LIKE 'import %' THEN ' Depends on: ' || stmt[8:] || '.' ELSE '' END AS summary
        FROM doc""",
    "doc_set": """SELECT repo, path, list_distinct(list_filter(list_transform(string_split(text, chr(10)),
            lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')) AS lines FROM doc""",
    # -- similarity ------------------------------------------------------------
    "class_of": """SELECT repo, path, lines, min(path) OVER (PARTITION BY repo, list_sort(lines)) AS v FROM doc_set""",
    "class": "SELECT repo, path AS v, lines, len(lines) AS n FROM class_of WHERE path = v",
    "token": "SELECT repo, v, n, unnest(lines) AS h FROM class",
    "pair": f"""SELECT a.repo, a.v AS u, b.v AS v, count(*) / (a.n + b.n - count(*)) AS similarity
        FROM token a JOIN token b ON a.repo = b.repo AND a.h = b.h AND a.v < b.v
        GROUP BY a.repo, a.v, b.v, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= {THRESHOLD}""",
    "vertex": """SELECT row_number() OVER (ORDER BY repo, v) AS rn, repo, v, smaller FROM (
            SELECT repo, v, coalesce(list(u) FILTER (WHERE u IS NOT NULL), []::VARCHAR[]) AS smaller FROM (
                SELECT repo, v, u FROM pair UNION ALL SELECT repo, u, NULL FROM pair) GROUP BY repo, v)""",
    "walk": """SELECT 0::BIGINT AS rn, []::VARCHAR[] AS openers
        UNION ALL
        SELECT x.rn, CASE WHEN list_has_any(w.openers, x.smaller) THEN w.openers ELSE list_append(w.openers, x.v) END
        FROM walk w JOIN vertex x ON x.rn = w.rn + 1""",
    "opener": "SELECT unnest(openers) AS v FROM (SELECT openers FROM walk ORDER BY rn DESC LIMIT 1)",
    "taken": """SELECT p.repo, p.v, min(p.u) AS opener FROM pair p WHERE p.u IN (SELECT v FROM opener)
        AND p.v NOT IN (SELECT v FROM opener) GROUP BY p.repo, p.v""",
    "placed": """SELECT c.repo, coalesce(t.opener, c.v) AS representative, c.path AS member FROM class_of c
        LEFT JOIN taken t ON c.repo = t.repo AND c.v = t.v""",
    "member": """SELECT repo, representative, member FROM placed
        QUALIFY count(*) OVER (PARTITION BY repo, representative) > 1""",
    "cluster": f"""SELECT repo, 'cluster_' || row_number() OVER (PARTITION BY repo ORDER BY representative) AS cluster_id,
            representative, count(*) AS size, {THRESHOLD}::DOUBLE AS threshold,
            sha1(representative || '|' || count(*) || '|' || sum(s1)::BIGINT || '|' || sum(s2)::BIGINT || '|' || sum(s3)::BIGINT || '|'
                || sum(s4)::BIGINT || '|' || sum(s5)::BIGINT) AS fingerprint
        FROM (SELECT *, ('0x' || d[1:8])::BIGINT AS s1, ('0x' || d[9:16])::BIGINT AS s2, ('0x' || d[17:24])::BIGINT AS s3,
                ('0x' || d[25:32])::BIGINT AS s4, ('0x' || d[33:40])::BIGINT AS s5 FROM (SELECT *, sha1(member) AS d FROM member))
        GROUP BY repo, representative""",
    # -- artifact --------------------------------------------------------------
    "doc_total": """SELECT d.repo, count(*) AS files, any_value(coalesce(c.n, 0)) AS clusters FROM doc d
        LEFT JOIN (SELECT repo, count(*) AS n FROM cluster GROUP BY repo) c ON d.repo = c.repo GROUP BY d.repo""",
    "plain_total": "SELECT repo, count(*) AS files, 0 AS clusters FROM doc GROUP BY repo",
    "node_xml": """SELECT repo, 2 AS section, path AS name, '    <node name="' || path || '"'
            || CASE WHEN dst IS NULL THEN ' type="leaf">' || chr(10) || '      <depends_on />'
                ELSE '>' || chr(10) || '      <depends_on>' || chr(10) || '        <dep>' || dst || '</dep>' || chr(10)
                    || '      </depends_on>' END
            || chr(10) || '    </node>' AS xml FROM doc_graph""",
    "module_xml": """SELECT d.repo, 8 AS section, d.path AS name, '    <module path="' || d.path || '">' || chr(10)
            || '      <classes />' || chr(10) || '      <functions />' || chr(10)
            || CASE WHEN stmt = '' THEN '      <imports />' ELSE '      <imports>' || chr(10) || '        <import>' || stmt
                || '</import>' || chr(10) || '      </imports>' END || chr(10)
            || '      <summary>' || summary || '</summary>' || chr(10) || '    </module>' AS xml
        FROM doc d JOIN doc_summary s ON d.repo = s.repo AND d.path = s.path""",
    "cluster_xml": """SELECT repo, 5 AS section, representative AS name, '    <cluster id="' || cluster_id
            || '" representative="' || representative || '" threshold="0.85" fingerprint="' || fingerprint || '">' || chr(10)
            || '      <members>' AS xml FROM cluster
        UNION ALL SELECT repo, 5, representative, '      </members>' || chr(10) || '    </cluster>' FROM cluster
        UNION ALL SELECT repo, 5, representative, '        <member>' || member || '</member>' FROM member""",
    "context_line": """SELECT repo, 0 AS section, '' AS name, '## Codebase Context' AS line FROM plain_total
        UNION ALL SELECT repo, 1, '', 'Repository: ' || repo FROM plain_total
        UNION ALL SELECT t.repo, 2, '', 'Files: ' || files || ' | Dependencies: '
            || (SELECT count(*) FROM doc_edge e WHERE e.repo = t.repo) FROM plain_total t
        UNION ALL SELECT repo, 3, '', '' FROM plain_total
        UNION ALL SELECT repo, 4, '', '### Architecture' FROM plain_total
        UNION ALL SELECT repo, 5, path, '  ' || path || CASE WHEN dst IS NULL THEN ' (leaf)' ELSE ' -> ' || dst END FROM doc_graph
        UNION ALL SELECT repo, 6, '', '' FROM plain_total
        UNION ALL SELECT repo, 7, '', '### Module Summaries' FROM plain_total
        UNION ALL SELECT repo, 8, path, path || ': ' || summary FROM doc_summary""",
    "context": "SELECT repo, string_agg(line, chr(10) ORDER BY section, name) AS text FROM context_line GROUP BY repo",
    "question": """SELECT ['en', 'de', 'fr', 'es', 'absent'][item_id % 5 + 1] AS repo, item_id // 5 + 1 AS q_no, text AS question
        FROM benchmark""",
    # -- pages -----------------------------------------------------------------
    "tag": r"""SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM (
        SELECT page_id, regexp_extract_all(regexp_replace(html,
            '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
            '</?[A-Za-z][A-Za-z0-9]*') AS tags FROM pages)""",
    "nested": """SELECT page_id, pos, tag NOT LIKE '</%' AS opens, lower(ltrim(tag, '</')) AS type,
            sum(CASE WHEN tag NOT LIKE '</%' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, lower(ltrim(tag, '</')) ORDER BY pos)
            + CASE WHEN tag NOT LIKE '</%' THEN 0 ELSE 1 END AS nesting FROM tag""",
    "filled": """SELECT *, coalesce(CASE WHEN opens THEN NOT lead(opens) OVER alike ELSE lag(opens) OVER alike END, false) AS filled
        FROM nested WINDOW alike AS (PARTITION BY page_id, type, nesting ORDER BY pos)""",
    "event": """SELECT page_id, pos, type, opens, filled, type IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link',
                'meta', 'source', 'track', 'wbr') AS void,
            sum(CASE WHEN opens AND filled THEN 1 WHEN filled THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)
            + CASE WHEN opens AND filled THEN 0 ELSE 1 END AS depth FROM filled WHERE opens OR filled""",
    "raw_node": """SELECT page_id, pos, type, depth,
            (SELECT max(b.pos) FROM event b WHERE b.page_id = e.page_id AND b.opens AND b.pos < e.pos
                AND (b.filled AND b.depth = e.depth - 1 OR NOT b.filled AND NOT b.void AND b.depth = e.depth)) AS parent,
            CASE WHEN void AND NOT filled THEN pos ELSE (SELECT min(b.pos) FROM event b WHERE b.page_id = e.page_id AND NOT b.opens
                AND b.depth = CASE WHEN e.filled THEN e.depth ELSE e.depth - 1 END AND b.pos > e.pos) END AS closing
        FROM event e WHERE opens""",
    "node": """SELECT CAST(page_id AS VARCHAR) AS tree_id, CAST(pos AS BIGINT) AS node_id, CAST(parent AS BIGINT) AS parent_id, type,
            row_number() OVER (PARTITION BY page_id, parent ORDER BY pos) AS child_ord,
            row_number() OVER (PARTITION BY page_id ORDER BY coalesce(closing, 1099511627776) DESC, pos) AS visit_ord
        FROM raw_node""",
    "h0": "SELECT *, sha1(type) AS h FROM node",
    # -- block trees of code: the only text read here, by a simpler pattern and joins of each file with itself
    "code_text": f"""SELECT repo, path, CASE k % 4
            WHEN 1 THEN {_filled(corpus.TS_ORDER)} WHEN 3 THEN {_filled(corpus.JS_ORDER)} ELSE {_filled(corpus.PY_ORDER)} END AS content
        FROM (SELECT o.*, coalesce(string_agg(CASE o.k % 4 WHEN 1 THEN 'import {{ Item }} from "../parts/part_' || p || '";'
                    WHEN 3 THEN 'require("../parts/part_' || p || '");' ELSE 'from parts.part_' || p || ' import Item' END
                    || chr(10), '' ORDER BY pos), '') AS imports,
                CASE WHEN o.k % 5 = 0 THEN {_text(corpus.PY_WIDE)} ELSE '' END AS wide,
                CASE WHEN o.k % 3 = 0 THEN {_text(corpus.PY_EXTRA)} ELSE '' END AS extra
            FROM ord o LEFT JOIN item i ON o.k = i.k GROUP BY ALL)
        UNION ALL
        SELECT repo, path, replace(CASE suffix WHEN '.ts' THEN {_text(corpus.TS_PART)} WHEN '/index.js' THEN {_text(corpus.JS_PART)}
            ELSE {_text(corpus.PY_PART)} END, '{{k}}', CAST(k AS VARCHAR)) FROM prt_file""",
    "code_token": r"""SELECT repo, path, py, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM (
        SELECT repo, path, path LIKE '%.py' AS py, CASE WHEN path LIKE '%.py'
            THEN regexp_extract_all(chr(10) || content, '"{3}[\s\S]*?"{3}|"(?:[^"\\\n]|\\.)*"|#[^\n]*|\n[ \t]*(?:\w+|"{3}[\s\S]*?"{3})|\w+|[()\[\]{}]')
            ELSE regexp_extract_all(content, '/\*[\s\S]*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|`[^`]*`|\w+|[()\[\]{}]') END AS tokens
        FROM code_text)""",
    "code_kind": f"""SELECT *, ltrim(token, chr(10) || ' ') AS word, token LIKE chr(10) || '%' AS starts,
            CASE WHEN py THEN ltrim(token, chr(10) || ' ') IN {PY_KEYWORDS} ELSE token IN {JS_KEYWORDS} END AS keyword,
            token IN ('(', '[', '{{') AS opens, token IN (')', ']', '}}') AS closes FROM code_token""",
    "code_depth": """SELECT *, length(token) - length(word) - 1 AS width,
            sum(opens::INT - closes::INT) OVER (PARTITION BY repo, path ORDER BY pos) - opens::INT AS depth
        FROM code_kind WHERE starts OR keyword OR opens OR closes""",
    "code_event": """SELECT *, starts AND depth <= 0 AS line, row_number() OVER (PARTITION BY repo, path ORDER BY pos) AS n
        FROM code_depth WHERE NOT (starts AND depth > 0 AND NOT keyword)""",
    "code_placed": """SELECT repo, path, n, CASE WHEN starts AND NOT keyword THEN 'line' ELSE word END AS type,
            coalesce(CASE WHEN line THEN
                (SELECT max(b.n) FROM code_event b WHERE b.repo = e.repo AND b.path = e.path AND b.line AND b.n < e.n AND b.width < e.width)
            WHEN depth > 0 THEN
                (SELECT max(b.n) FROM code_event b WHERE b.repo = e.repo AND b.path = e.path AND b.opens AND b.n < e.n AND b.depth = e.depth - 1)
            ELSE (SELECT max(b.n) FROM code_event b WHERE b.repo = e.repo AND b.path = e.path AND b.line AND b.n < e.n) END, 0) AS parent,
            CASE WHEN line THEN 2 * coalesce((SELECT min(b.n) FROM code_event b
                    WHERE b.repo = e.repo AND b.path = e.path AND b.line AND b.n > e.n AND b.width <= e.width), 1099511627776) - 1
                WHEN opens THEN 2 * coalesce((SELECT min(b.n) FROM code_event b
                    WHERE b.repo = e.repo AND b.path = e.path AND b.closes AND b.n > e.n AND b.depth = e.depth), 1099511627776)
                ELSE 2 * n END AS ends
        FROM code_event e WHERE NOT closes
        UNION ALL SELECT repo, path, 0, 'module', NULL, 4398046511104 FROM code_text""",
    "code_node": """SELECT repo || chr(9) || path AS tree_id, repo, path, CAST(n AS BIGINT) AS node_id, CAST(parent AS BIGINT) AS parent_id, type,
            row_number() OVER (PARTITION BY repo, path, parent ORDER BY n) AS child_ord,
            row_number() OVER (PARTITION BY repo, path ORDER BY ends DESC, n) AS visit_ord
        FROM code_placed""",
    "c0": "SELECT *, sha1(type) AS h FROM code_node",
    # Openers one after the other, over files of one fingerprint set as one: they are alike and have the same neighbours.
    "code_set": """SELECT repo, path, list_sort(list_distinct(list(h))) AS hs FROM c4 GROUP BY repo, path""",
    "code_class": """SELECT repo, hs, min(path) AS v, row_number() OVER (ORDER BY repo, min(path)) AS i FROM code_set GROUP BY repo, hs""",
    "code_near": f"""SELECT a.repo, a.i, list(b.i) AS near FROM code_class a JOIN code_class b ON a.repo = b.repo AND b.i < a.i
        AND len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))) >= {THRESHOLD} GROUP BY a.repo, a.i""",
    "code_scan": """SELECT 0::BIGINT AS i, []::BIGINT[] AS openers
        UNION ALL SELECT s.i + 1, CASE WHEN n.near IS NOT NULL AND list_has_any(s.openers, n.near) THEN s.openers ELSE list_append(s.openers, s.i + 1) END
        FROM code_scan s LEFT JOIN code_near n ON n.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM code_class)""",
    "code_taken": """SELECT c.*, CASE WHEN list_contains(o.openers, c.i) THEN c.i ELSE list_min(list_intersect(o.openers, n.near)) END AS opener
        FROM code_class c LEFT JOIN code_near n ON c.i = n.i, (SELECT openers FROM code_scan ORDER BY i DESC LIMIT 1) o""",
    # -- the whole run over selected files
    "sel_file": """SELECT s.repo, s.path, s.k, t.content, f.hs FROM (SELECT * FROM scattered WHERE {kept}) s
            JOIN ord o ON o.k = s.k JOIN code_text t ON t.repo = o.repo AND t.path = o.path JOIN code_set f ON f.repo = o.repo AND f.path = o.path
        UNION ALL SELECT p.repo, p.path, NULL, t.content, f.hs FROM prt_file p
            JOIN code_text t ON t.repo = p.repo AND t.path = p.path JOIN code_set f ON f.repo = p.repo AND f.path = p.path""",
    "sel_class": "SELECT repo, hs, min(path) AS v, count(*) AS copies, row_number() OVER (ORDER BY repo, min(path)) AS i FROM sel_file GROUP BY repo, hs",
    "sel_near": f"""SELECT a.i, list(b.i) AS near FROM sel_class a JOIN sel_class b ON a.repo = b.repo AND b.i < a.i
        AND len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))) >= {THRESHOLD} GROUP BY a.i""",
    "sel_scan": """SELECT 0::BIGINT AS i, []::BIGINT[] AS openers
        UNION ALL SELECT s.i + 1, CASE WHEN n.near IS NOT NULL AND list_has_any(s.openers, n.near) THEN s.openers ELSE list_append(s.openers, s.i + 1) END
        FROM sel_scan s LEFT JOIN sel_near n ON n.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM sel_class)""",
    "sel_cluster": """SELECT repo, opener, sum(copies) AS size FROM (
            SELECT c.repo, c.copies, CASE WHEN list_contains(o.openers, c.i) THEN c.i ELSE list_min(list_intersect(o.openers, n.near)) END AS opener
            FROM sel_class c LEFT JOIN sel_near n ON c.i = n.i, (SELECT openers FROM sel_scan ORDER BY i DESC LIMIT 1) o)
        GROUP BY repo, opener HAVING sum(copies) > 1""",
    "code_member": """SELECT t.repo, o.v AS representative, s.path AS member FROM code_taken t JOIN code_class o ON t.opener = o.i
        JOIN code_set s ON s.repo = t.repo AND s.hs = t.hs
        QUALIFY count(*) OVER (PARTITION BY t.opener) > 1""",
}
for _name, _of in (("h", "node"), ("c", "code_node")):
    for _d in range(1, 5):
        CTE[f"{_name}{_d}"] = f"""SELECT n.*, sha1(n.type || '(' || coalesce(c.kids, '') || ')') AS h FROM {_of} n LEFT JOIN (
            SELECT tree_id, parent_id, string_agg(h, ',' ORDER BY child_ord) AS kids FROM {_name}{_d - 1} GROUP BY tree_id, parent_id
            ) c ON n.tree_id = c.tree_id AND n.node_id = c.parent_id"""


def _frame(totals: str) -> str:
    stamp = f"</files_count>' || chr(10) || '    <generated_at>{STAMP}</generated_at>' || chr(10) || '  </metadata>'"
    return f"""SELECT repo, 0 AS section, '' AS name, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10)
            || '<sourcelake version="0.1" repo="' || repo || '">' || chr(10) || '  <metadata>' || chr(10) || '    <files_count>'
            || files || '{stamp} AS xml FROM {totals}
        UNION ALL SELECT repo, 1, '', '  <dependency_graph>' FROM {totals}
        UNION ALL SELECT repo, 3, '', '  </dependency_graph>' FROM {totals}
        UNION ALL SELECT repo, 4, '', '  <patterns>' FROM {totals} WHERE clusters > 0
        UNION ALL SELECT repo, 6, '', '  </patterns>' FROM {totals} WHERE clusters > 0
        UNION ALL SELECT repo, 7, '', '  <modules>' FROM {totals}
        UNION ALL SELECT repo, 9, '', '  </modules>' || chr(10) || '</sourcelake>' FROM {totals}"""


CTE["plain_xml"] = _frame("plain_total") + " UNION ALL SELECT * FROM node_xml UNION ALL SELECT * FROM module_xml"
CTE["full_xml"] = (
    _frame("doc_total")
    + " UNION ALL SELECT * FROM node_xml UNION ALL SELECT * FROM module_xml UNION ALL SELECT * FROM cluster_xml"
)
CTE["size"] = """SELECT repo, CAST(ceil((sum(length(xml)) + count(*) - 1) / 4.0) AS BIGINT) AS artifact_tokens,
        CAST(sum(strlen(xml)) + count(*) - 1 AS BIGINT) AS artifact_bytes FROM full_xml GROUP BY repo"""
CTE["raw"] = """SELECT repo, count(*) AS files, CAST(ceil((sum(length(content)) + count(*) - 1) / 4.0) AS BIGINT) AS raw_tokens
        FROM doc_content GROUP BY repo"""
CTE["metric"] = """SELECT r.repo, r.files,
            (SELECT count(*) FROM doc_edge e WHERE e.repo = r.repo) AS edges,
            (SELECT count(*) FROM cluster c WHERE c.repo = r.repo) AS clusters,
            (SELECT coalesce(max(size), 0) FROM cluster c WHERE c.repo = r.repo) AS largest_cluster,
            r.raw_tokens, s.artifact_tokens, s.artifact_bytes
        FROM raw r JOIN size s ON r.repo = s.repo"""


def _needs(text: str, known=None) -> list[str]:
    """Names of the CTEs ``text`` uses, dependencies first."""
    import re

    known = [] if known is None else known
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
        if name in CTE and name not in known:
            known.append(name)
            before = len(known)
            _needs(CTE[name], known)
            # dependencies found behind it move in front
            moved = known[before:]
            del known[before:]
            at = known.index(name)
            known[at:at] = moved
    return known


def with_ctes(select: str) -> str:
    names = _needs(select)
    if not names:
        return select
    return "WITH RECURSIVE " + ",\n".join(f'"{n}" AS ({CTE[n]})' for n in names) + "\n" + select


def _kept(condition: str) -> str:
    return f"SELECT repo, path FROM scattered WHERE {condition}"


_IGNORED = """place IN (1, 7, 9, 12) OR (place = 10 AND k % 2 = 0) OR (place = 13 AND k % 2 = 1)
    OR (place = 14 AND k % 2 = 0) OR (place = 11 AND k % 4 = 3)"""

_SELECTED = f"place NOT IN (0, 3, 4, 5) AND NOT ({_IGNORED})"
CTE["sel_file"] = CTE["sel_file"].replace("{kept}", _SELECTED)

_TOKENS = r"""SELECT doc_id, list_transform(regexp_extract_all(text,
    '"{3}[\s\S]*?"{3}|''''''[\s\S]*?''''''|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|\d[\w.]*|[\w$]+|[^\s\w$]'),
    lambda t: CASE WHEN list_contains([{keywords}], t) THEN t WHEN regexp_matches(t, '^[A-Za-z_$]') THEN 'I'
        WHEN regexp_matches(t, '^(?:\d|["''][\s\S])') THEN 'L' ELSE t END) AS t FROM documents"""


def _shingle_sql() -> str:
    from sourcelake.operators.shingles import KEYWORDS

    tokens = _TOKENS.replace("{keywords}", ", ".join(f"'{w}'" for w in KEYWORDS))
    return f"""SELECT doc_id, len(t) AS n_tokens, len(s) AS n_shingles, list_aggregate(s, 'min') AS first_shingle,
        list_aggregate(s, 'max') AS last_shingle FROM (
        SELECT doc_id, t, CASE WHEN len(t) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1),
            lambda i: array_to_string(t[i:i + 4], ' '))) END AS s FROM ({tokens}))"""


_PROMPT = """'Summarize this Python module for a codebase overview artifact.' || chr(10) || chr(10) || 'File: ' || path
    || chr(10) || chr(10) || 'Structure:' || chr(10) || 'Classes: []' || chr(10) || 'Functions: []' || chr(10) || 'Imports: ['
    || CASE WHEN stmt = '' THEN '' ELSE '''' || stmt || '''' END || ']' || chr(10) || chr(10) || 'Source code:' || chr(10)
    || '```python' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) || 'Instructions:' || chr(10)
    || '- Describe what this module does in 2-3 sentences max.' || chr(10) || '- List the key responsibilities.' || chr(10)
    || '- Note any important side effects, global state, or external dependencies.' || chr(10)
    || '- Keep the summary under 150 tokens.' || chr(10)
    || '- Focus on architectural role, not implementation details.' || chr(10) || chr(10) || 'Summary:'"""

_SYMBOL = "SELECT repo, path, kind, CAST(pos AS BIGINT) AS pos, name FROM"
_PLACEHOLDER = "PLACEHOLDER - will be filled by LLM summarizer in Phase 2"

_CANDIDATES = """SELECT repo, path, pos, unnest(range(len(c))) AS ord, unnest(c) AS candidate FROM (
    SELECT repo, path, pos, CASE
        WHEN k % 2 = 0 AND text LIKE 'from parts%' THEN list_transform(['.py', '/__init__.py'],
            lambda s: 'parts/' || regexp_extract(text, 'part_[0-9]+') || s)
        WHEN k % 2 = 0 THEN list_transform(['.py', '/__init__.py'],
            lambda s: CASE WHEN text LIKE 'from tools%' THEN 'tools' ELSE text[8:] END || s)
        WHEN text LIKE '%../parts%' THEN list_transform(
            ['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'],
            lambda s: 'parts/' || regexp_extract(text, 'part_[0-9]+') || s)
        ELSE [] END AS c FROM imp)"""

_SELECTS = {
    "scan_files": """SELECT repo, path, length(content) AS chars, md5(content) AS content_md5 FROM (
        SELECT coalesce(lang, 'none') AS repo,
            ['_gen/', '.git/', 'a/b/c/', '', '.cfg/d/'][doc_id % 5 + 1] || 'doc_' || doc_id || ['.py', '.ts', '.md', '.jsx'][doc_id % 4 + 1] AS path,
            regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS content
        FROM documents) WHERE path NOT LIKE '.git/%' AND path NOT LIKE '%.md'""",
    "filter_extension": _kept("place NOT IN (3, 4)"),
    "filter_ignored": _kept(f"NOT ({_IGNORED})"),
    "select_files": _kept(_SELECTED),
    "filter_tests": _kept("place NOT IN (0, 5)"),
    "filter_filenames": _kept("place <> 4"),
    "count_source_files": """SELECT repo, count(*) AS source_files FROM scattered
        WHERE place NOT IN (1, 2, 3, 4, 9, 11) GROUP BY repo""",
    "detect_language": """SELECT repo, path, CASE WHEN place = 4 THEN 'unknown' WHEN suffix = '.py' THEN 'python'
        WHEN suffix = '.ts' THEN 'typescript' ELSE 'javascript' END AS language FROM scattered""",
    "extract_functions_py": f"{_SYMBOL} fn WHERE path LIKE '%.py'",
    "extract_classes": f"{_SYMBOL} cls",
    "extract_imports_py": "SELECT repo, path, 'imports' AS kind, pos, text AS name FROM imp WHERE k % 2 = 0",
    "extract_imports_js": "SELECT repo, path, 'imports' AS kind, pos, text AS name FROM imp WHERE k % 2 = 1",
    "extract_functions_js": f"{_SYMBOL} fn WHERE path NOT LIKE '%.py'",
    "extract_ts_types": f"{_SYMBOL} ts_types UNION ALL {_SYMBOL} exported",
    "extract_structure": """SELECT repo, path, kind, count(*) AS n, string_agg(name, '|' ORDER BY pos) AS names FROM (
        SELECT * FROM fn UNION ALL SELECT * FROM cls UNION ALL SELECT * FROM exported UNION ALL SELECT * FROM ts_types
        UNION ALL SELECT repo, path, 'imports', pos, text FROM imp) GROUP BY repo, path, kind""",
    "module_name": """SELECT repo, path, pos, CASE WHEN text LIKE 'from parts%' THEN 'parts.' || regexp_extract(text, 'part_[0-9]+')
        WHEN text LIKE 'from tools%' THEN 'tools' ELSE text[8:] END AS module FROM imp WHERE k % 2 = 0""",
    "js_specifier": """SELECT repo, path, pos, CASE WHEN text LIKE 'require:%' THEN text[9:]
        ELSE regexp_extract(text, '"(.*)"', 1) END AS specifier FROM imp WHERE k % 2 = 1""",
    "import_candidates": _CANDIDATES,
    "resolve_imports": "SELECT repo, path, pos, dst FROM imp",
    "dependency_edges": "SELECT repo, path AS src, dst, pos FROM imp WHERE dst IS NOT NULL",
    "external_imports": "SELECT repo, path, pos, text AS import_text FROM imp WHERE dst IS NULL",
    "graph_nodes": "SELECT repo, path FROM code",
    "leaf_nodes": """SELECT repo, path FROM code c WHERE NOT EXISTS (
        SELECT 1 FROM imp i WHERE i.repo = c.repo AND i.path = c.path AND i.dst IS NOT NULL)""",
    "adjacency": """SELECT c.repo, c.path, coalesce(string_agg(dst, ',' ORDER BY dst), '') AS depends_on,
        coalesce(string_agg(text, '|' ORDER BY pos) FILTER (WHERE dst IS NULL), '') AS "external"
        FROM code c LEFT JOIN imp i ON c.repo = i.repo AND c.path = i.path GROUP BY c.repo, c.path""",
    "html_tree_nodes": "SELECT tree_id, node_id, parent_id, child_ord, visit_ord, type FROM node",
    "subtree_hash": "SELECT tree_id, node_id, h FROM h4",
    "fingerprint_set": "SELECT DISTINCT tree_id, h FROM h4 ",
    "code_tree_nodes": "SELECT repo, path, node_id, parent_id, child_ord, visit_ord, type FROM code_node",
    "code_fingerprints": "SELECT DISTINCT repo, path, h FROM c4",
    "code_clusters": "SELECT repo, representative, member FROM code_member",
    "selected_pipeline": """SELECT f.repo, count(*) AS files,
            CAST((SELECT count(*) FROM imp i JOIN sel_file s ON s.k = i.k WHERE i.dst IS NOT NULL AND i.repo = f.repo) AS BIGINT) AS edges,
            CAST((SELECT count(*) FROM sel_cluster c WHERE c.repo = f.repo) AS BIGINT) AS clusters,
            CAST(coalesce((SELECT max(size) FROM sel_cluster c WHERE c.repo = f.repo), 0) AS BIGINT) AS largest_cluster,
            CAST(ceil((sum(length(content)) + count(*) - 1) / 4.0) AS BIGINT) AS raw_tokens
        FROM sel_file f GROUP BY f.repo""",
    "rejected_files": "SELECT repo, path FROM scattered WHERE path LIKE '%.lock'",
    "shape_shingles": _shingle_sql(),
    "jaccard": """SELECT e.repo, e.src, e.dst, round(len(list_intersect(a.lines, b.lines))
            / len(list_distinct(list_concat(a.lines, b.lines))), 6) AS similarity
        FROM doc_edge e JOIN doc_set a ON e.repo = a.repo AND e.src = a.path JOIN doc_set b ON e.repo = b.repo AND e.dst = b.path""",
    "similar_pairs": """SELECT m.repo, representative AS opener, member, round(len(list_intersect(a.lines, b.lines))
            / len(list_distinct(list_concat(a.lines, b.lines))), 6) AS similarity
        FROM member m JOIN doc_set a ON m.repo = a.repo AND m.member = a.path
        JOIN doc_set b ON m.repo = b.repo AND m.representative = b.path WHERE representative <> member""",
    "greedy_cluster": "SELECT repo, representative, member FROM member",
    "cluster_ids": "SELECT repo, cluster_id, representative, size, threshold, fingerprint FROM cluster",
    "summary_prompt": f"""SELECT repo, path, md5({_PROMPT}) AS prompt_md5, length({_PROMPT}) AS chars FROM doc_content""",
    "template_summary": "SELECT repo, path, summary FROM summary",
    "dependency_mentions": "SELECT repo, path, replace(mentions, 'require:', '') AS mentions FROM mention",
    "cache_key": "SELECT repo, path, key FROM summary",
    "cached_summaries": """SELECT repo, path, coalesce(nullif(s.cached, ''), c.summary) AS summary
        FROM summary c LEFT JOIN seed s ON c.key = s.key""",
    "cache_upsert": """SELECT c.key, coalesce(nullif(s.cached, ''), c.summary) AS summary
        FROM summary c LEFT JOIN seed s ON c.key = s.key""",
    "inject_summaries": f"""SELECT repo, path, CASE WHEN what = 'order' THEN summary ELSE '{_PLACEHOLDER}' END AS summary
        FROM summary""",
    "incremental_summaries": f"""SELECT DISTINCT event_type || '|users/user_' || user_id || '.py|' || epoch(ts::DATE)::BIGINT
            || '|{VERSION}' AS key,
        'Module user_' || user_id || ' with 1 functions, 0 classes. Depends on: ' || event_type || '.' AS summary FROM events""",
    "count_tokens": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "raw_tokens": "SELECT repo, raw_tokens FROM raw",
    "build_artifact": "SELECT repo, CAST(section AS BIGINT) AS section, name, xml FROM full_xml",
    "scan_artifact": f"""SELECT repo, 'edge' AS kind, src AS a, dst AS b FROM doc_edge
        UNION ALL SELECT repo, 'module', path, summary FROM doc_summary
        UNION ALL SELECT repo, 'member', representative, member FROM member
        UNION ALL SELECT repo, CASE WHEN dst IS NULL THEN 'leaf' ELSE 'node' END, path, NULL FROM doc_graph
        UNION ALL SELECT repo, 'files', CAST(files AS VARCHAR), '{STAMP}' FROM plain_total""",
    "artifact_size": "SELECT repo, artifact_tokens, artifact_bytes FROM size",
    "compression_ratio": """SELECT repo, raw_tokens, artifact_tokens, round(artifact_tokens / raw_tokens, 6) AS compression_ratio
        FROM metric""",
    "pipeline_metrics": "SELECT * FROM metric",
    "artifact_status": f"""SELECT repo, count(*) AS modules, count(*) AS files,
        CAST((SELECT count(*) FROM imp i WHERE i.repo = c.repo AND dst IS NOT NULL) AS BIGINT) AS edges, '{STAMP}' AS generated_at
        FROM code c GROUP BY repo""",
    "context_block": """SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY section, name) AS BIGINT) AS no, line
        FROM context_line""",
    "prompt_pairs": """SELECT q.repo || '_q' || q_no AS id, question, question AS baseline_prompt,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) || question AS context_suffix,
        CAST(ceil(length(text) / 4.0) AS BIGINT) AS context_tokens,
        CAST(ceil((length(text) + length(question) + 7) / 4.0) AS BIGINT) AS prompt_tokens
        FROM question q JOIN context c ON q.repo = c.repo""",
    "write_prompts": """SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY section, name) AS VARCHAR) AS id, md5(line) AS text_md5
        FROM context_line
        UNION ALL SELECT q.repo, q.repo || '_q' || q_no,
        md5(chr(10) || chr(10) || '---' || chr(10) || chr(10) || question) FROM question q JOIN context c ON q.repo = c.repo""",
    "avg_context_tokens": """SELECT count(*) AS questions, round(avg(ceil(length(text) / 4.0)), 6) AS avg_context_tokens
        FROM question q JOIN context c ON q.repo = c.repo""",
}
_SELECTS["read_cache"] = _SELECTS["cache_upsert"]

ORACLES = {name: with_ctes(select) for name, select in _SELECTS.items()}
