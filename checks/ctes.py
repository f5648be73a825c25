"""The derived inputs again, as DuckDB common table expressions.

``query(body)`` puts in front of ``body`` the expressions it mentions, and those they mention.
"""

from __future__ import annotations

import re

# Fixed value: the pattern of a citation.
CITATION = r"\[\d+(?:\s*[,;–-]\s*\d+)*\]|\([A-ZÀ-Ỹ][^()\n]{0,100},\s*\d{4}[a-z]?\)"

CTES = {
    "doc_lines": """
        SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
               unnest(string_split(text, chr(10))) AS line
        FROM documents""",
    "keyed_lines": "SELECT *, (doc_id * 7 + i * 3) % 16 AS k FROM doc_lines",
    "layout_blocks": """
        SELECT doc_id AS artifact_id, i // 8 + 1 AS page_no, i % 8 AS ordinal,
               CASE WHEN i = 0 THEN 'doc_title' WHEN k = 1 THEN 'paragraph_title'
                    WHEN k = 2 THEN 'table' WHEN k IN (3, 6) THEN 'figure_title'
                    WHEN k IN (0, 4, 9) THEN 'image' WHEN k = 5 THEN 'header'
                    WHEN k = 7 THEN 'table_title' WHEN k = 13 THEN 'display_formula'
                    ELSE 'text' END AS label,
               (CASE WHEN i > 0 AND k = 1 THEN (i % 9 + 1)::VARCHAR ||
                     CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.1.1' END || ' '
                     ELSE '' END) || line ||
               (CASE WHEN i = 0 THEN '' WHEN k IN (8, 12) THEN ' [' || (i + 1)::VARCHAR || ']'
                     WHEN k = 10 THEN ' (Nguyen, 2020) [3, 4]' WHEN k = 11 THEN ' 😀 [3] [3]'
                     ELSE '' END) AS content,
               i * 37 % 200 AS x0, i % 8 * 100 AS y0,
               i * 37 % 200 + 100 + i % 5 * 60 AS x1, i % 8 * 100 + 80 AS y1
        FROM keyed_lines""",
    "found": f"""
        SELECT *, regexp_extract_all(content, '{CITATION}') AS hits
        FROM layout_blocks""",
    "parsed": """
        SELECT *, len(hits) AS n_matches,
               list_filter(hits, lambda h, j: list_position(hits, h) = j) AS markers,
               'p' || page_no || '-b' || ordinal AS external_id,
               CASE WHEN label = 'table' THEN 'table'
                    WHEN label IN ('image', 'figure', 'chart') THEN 'figure'
                    WHEN label IN ('formula', 'display_formula', 'equation') THEN 'equation'
                    ELSE 'text' END AS block_type,
               label IN ('doc_title', 'paragraph_title', 'section_title', 'header', 'footer',
                         'page_number', 'figure_title', 'table_title', 'figure_caption',
                         'table_caption', 'reference', 'reference_content')
                 AS exclude_from_claims,
               nullif(sum(CASE WHEN label IN ('doc_title', 'paragraph_title', 'section_title')
                               THEN 1 ELSE 0 END)
                      OVER (PARTITION BY artifact_id ORDER BY page_no, ordinal), 0)::BIGINT - 1
                 AS section_ordinal,
               coalesce(sum(len(hits) + 1) OVER (PARTITION BY artifact_id, page_no
                   ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
                 AS reading_order
        FROM found""",
    "sections": r"""
        SELECT artifact_id, section_ordinal AS ordinal, content AS title, page_no AS page_start,
               CASE WHEN regexp_matches(content, '^\d+(\.\d+)*[.)]?\s')
                    THEN len(string_split(regexp_extract(content, '^(\d+(\.\d+)*)', 1), '.'))
                    ELSE 1 END AS level
        FROM parsed WHERE label IN ('doc_title', 'paragraph_title', 'section_title')""",
    "outline": """
        SELECT s.*,
               (SELECT max(p.ordinal) FROM sections p WHERE p.artifact_id = s.artifact_id
                  AND p.ordinal < s.ordinal AND p.level < s.level) AS parent_ordinal,
               (SELECT min(p.ordinal) FROM sections p WHERE p.artifact_id = s.artifact_id
                  AND p.ordinal > s.ordinal AND p.level <= s.level) AS next_ordinal
        FROM sections s""",
    "spans": """
        SELECT o.*, (SELECT max(b.page_no) FROM parsed b WHERE b.artifact_id = o.artifact_id
                       AND b.section_ordinal >= o.ordinal
                       AND b.section_ordinal < coalesce(o.next_ordinal, 1000000000)) AS page_end
        FROM outline o""",
    "section_tree": """
        SELECT artifact_id, ordinal,
               CASE WHEN title <> '' THEN [title] ELSE []::VARCHAR[] END AS path
        FROM outline WHERE parent_ordinal IS NULL
        UNION ALL
        SELECT o.artifact_id, o.ordinal,
               t.path || CASE WHEN o.title <> '' THEN [o.title] ELSE []::VARCHAR[] END
        FROM section_tree t JOIN outline o
          ON o.artifact_id = t.artifact_id AND o.parent_ordinal = t.ordinal""",
    "citation_rows": f"""
        SELECT artifact_id, page_no, ordinal, external_id AS parent_external_id, section_ordinal,
               reading_order + 1 + j AS reading_order, hits[j + 1] AS content, x0, y0, x1, y1,
               (list_sum(list_transform(gaps[1:j + 1], lambda g: len(g)))
                + coalesce(list_sum(list_transform(hits[1:j], lambda h: len(h))), 0))::BIGINT
                 AS span_start, j
        FROM (SELECT *, string_split_regex(content, '{CITATION}') AS gaps,
                     unnest(range(len(hits))) AS j
              FROM parsed WHERE len(hits) > 0)""",
    "citations": """
        SELECT artifact_id, page_no, parent_external_id || '-citation-' || j AS external_id,
               parent_external_id, section_ordinal, reading_order, content, x0, y0, x1, y1,
               span_start, span_start + len(content) AS span_end
        FROM citation_rows""",
    "caption_groups": """
        SELECT artifact_id, page_no, section_ordinal, kind,
               list({'ordinal': ordinal, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY ordinal)
                 FILTER (WHERE is_caption) AS caps,
               list({'ordinal': ordinal, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY ordinal)
                 FILTER (WHERE NOT is_caption) AS goals
        FROM (SELECT *, label IN ('figure_title', 'figure_caption', 'table_title', 'table_caption')
                          AS is_caption,
                     CASE WHEN label IN ('figure_title', 'figure_caption') THEN 'figure'
                          WHEN label IN ('table_title', 'table_caption') THEN 'table'
                          ELSE block_type END AS kind
              FROM parsed)
        WHERE is_caption OR block_type IN ('figure', 'table')
        GROUP BY ALL HAVING len(caps) > 0 AND len(goals) > 0""",
    "caption_steps": """
        SELECT *, 0 AS step, []::BIGINT[] AS used FROM caption_groups
        UNION ALL
        SELECT artifact_id, page_no, section_ordinal, kind, caps, goals, step + 1,
               list_append(used, coalesce(list_min(list_transform(
                 list_filter(goals, lambda t: NOT list_contains(used, t.ordinal)
                   AND least(t.x1, caps[step + 1].x1) > greatest(t.x0, caps[step + 1].x0)),
                 lambda t: {'d': least(abs(t.y1 - caps[step + 1].y0),
                                       abs(caps[step + 1].y1 - t.y0)), 'o': t.ordinal})).o, -1))
        FROM caption_steps WHERE step < len(caps)""",
    "caption_links": """
        SELECT artifact_id, page_no, goal AS ordinal, 'p' || page_no || '-b' || cap AS caption
        FROM (SELECT artifact_id, page_no, unnest(used) AS goal,
                     unnest(list_transform(caps, lambda c: c.ordinal)) AS cap
              FROM caption_steps WHERE step = len(caps))
        WHERE goal >= 0""",
    "candidates": """
        SELECT * FROM parsed WHERE block_type = 'text' AND content <> ''
          AND NOT exclude_from_claims""",
    "grouped": """
        SELECT *, dense_rank() OVER (PARTITION BY artifact_id ORDER BY first_seen) - 1
                    AS group_rank,
               row_number() OVER (PARTITION BY artifact_id, section_ordinal
                                  ORDER BY page_no, reading_order) - 1 AS position
        FROM (SELECT *, min(page_no * 1000000 + reading_order)
                          OVER (PARTITION BY artifact_id, section_ordinal) AS first_seen
              FROM candidates)""",
    "packable": """
        SELECT *, len(content) AS n FROM grouped
        WHERE artifact_id NOT IN (SELECT artifact_id FROM grouped WHERE len(content) > 24000)""",
    "packing": """
        SELECT artifact_id, group_rank, position, n AS filled, 0 AS batch_no
        FROM packable WHERE position = 0
        UNION ALL
        SELECT g.artifact_id, g.group_rank, g.position,
               CASE WHEN p.filled + g.n > 24000 THEN g.n ELSE p.filled + g.n END,
               p.batch_no + CASE WHEN p.filled + g.n > 24000 THEN 1 ELSE 0 END
        FROM packing p JOIN packable g ON g.artifact_id = p.artifact_id
          AND g.group_rank = p.group_rank AND g.position = p.position + 1""",
    "batched": """
        SELECT g.*, p.batch_no FROM packable g JOIN packing p
          USING (artifact_id, group_rank, position)""",
    "claims_said": """
        SELECT *, (page_no - 1) * 8 + ordinal AS i,
               CASE (artifact_id + (page_no - 1) * 8 + ordinal) % 4 WHEN 0 THEN 'text'
                    WHEN 1 THEN 'factual' WHEN 2 THEN 'citation' ELSE 'implementation' END
                 AS claim_type,
               content AS claim_text, len(content) AS span_end
        FROM batched""",
    "claims_with_ids": """
        SELECT *, sha256('{"source":"' || external_id || '","span":{"end":' || span_end ||
                         ',"start":0},"text":' || to_json(claim_text)::VARCHAR ||
                         ',"type":"' || claim_type || '"}') AS claim_id
        FROM claims_said""",
    "artifacts": """
        SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber
                 || '-' || l_quantity::BIGINT AS artifact_id,
               l_orderkey AS submission_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'report_pdf' ELSE 'source_archive' END AS kind,
               l_linenumber::BIGINT AS version_no, l_quantity::BIGINT * 1000 AS byte_size,
               CASE WHEN l_partkey % 11 = 0 THEN 'http' ELSE 'cloudinary' END ||
               '://raw/authenticated/corpus/submissions/' || l_orderkey || '/' ||
               CASE WHEN l_suppkey % 2 = 0 THEN 'report_pdf' ELSE 'source_archive' END || '/' ||
               CASE WHEN l_partkey % 11 = 2 THEN '../' ELSE '' END || l_partkey ||
               CASE WHEN l_partkey % 11 = 1 THEN '?x=1' ELSE '' END AS object_uri,
               sha256(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber
                      || '-' || l_quantity::BIGINT) AS sha256,
               l_partkey
        FROM lineitem""",
    "measured": """
        SELECT artifact_id, byte_size + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END
                 AS measured_size,
               CASE WHEN l_partkey % 17 = 0 THEN sha256('x') ELSE sha256 END AS measured_sha256,
               l_partkey % 7 <> 0 AS signed
        FROM artifacts""",
    "submissions": """
        SELECT o_orderkey AS submission_id, o_custkey AS project_id, o_custkey AS group_id,
               o_orderkey % 7 AS submitted_by_user_id,
               o_custkey + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS rubric_version_id,
               1 + o_orderkey % 3 AS attempt_no,
               CASE WHEN o_orderkey % 4 = 0 THEN 'k' || o_custkey END AS idempotency_key,
               CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing'
                    ELSE 'completed' END AS status,
               o_orderdate AS received_at
        FROM orders""",
    "stored": "SELECT * FROM submissions WHERE received_at < TIMESTAMP '1998-05-01'",
    "requests": """
        SELECT submission_id AS request_id, * EXCLUDE (submission_id) FROM submissions
        WHERE received_at >= TIMESTAMP '1998-05-01'""",
    "projects": """
        SELECT c_custkey AS project_id,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'closed' WHEN 'AUTOMOBILE' THEN 'draft'
                    ELSE 'open' END AS status
        FROM customer""",
    "rubrics": """
        SELECT c_custkey AS rubric_version_id, c_custkey AS project_id,
               CASE WHEN c_custkey % 5 = 0 THEN 'draft' ELSE 'published' END AS status
        FROM customer""",
    "members": """
        SELECT c_custkey AS group_id, c_custkey AS project_id, unnest([0, 1, 2, 3, 4]) AS user_id
        FROM customer""",
    "raw_nodes": """
        SELECT p_partkey % 50 AS graph_id, p_partkey::VARCHAR AS id, p_name AS label,
               CASE WHEN p_partkey % 31 <> 0 THEN 'src/' || p_brand || '.py' END AS source_file,
               'L' || p_size AS source_location, p_size AS start_line, p_size AS end_line,
               CASE p_type WHEN 'STANDARD' THEN 'AMBIGUOUS' WHEN 'PROMO' THEN 'INFERRED'
                    ELSE 'EXTRACTED' END AS tag,
               NULL::DOUBLE AS score, p_size > 45 AS callable_class, p_size > 25 AS callable
        FROM part""",
    "raw_edges": """
        SELECT l_partkey % 50 AS graph_id, l_partkey::VARCHAR AS source,
               (l_partkey + 50 * (l_suppkey % 5))::VARCHAR AS target,
               CASE l_linenumber WHEN 1 THEN 'method' WHEN 2 THEN 'imports_from' WHEN 3 THEN 'calls'
                    ELSE 'references' END AS relation,
               CASE WHEN l_partkey % 31 <> 0 THEN 'src/' || p_brand || '.py' END AS source_file,
               'L' || l_linenumber || '-L' || (l_linenumber + l_quantity)::BIGINT
                 AS source_location,
               l_linenumber AS start_line, (l_linenumber + l_quantity)::BIGINT AS end_line,
               CASE WHEN l_partkey % 50 % 10 = 0 THEN
                    CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED'
                         ELSE 'AMBIGUOUS' END
                    ELSE CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 'EXTRACTED'
                         WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END END AS tag,
               CASE WHEN (l_partkey + l_linenumber) % 4 <> 0
                    THEN ((l_partkey + 2 * l_linenumber) % 11)::DOUBLE / 10 END AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "inventory": """
        SELECT DISTINCT graph_id, source_file AS path,
               CASE WHEN graph_id % 10 = 1 THEN 40 ELSE 60 END AS line_count
        FROM raw_nodes WHERE source_file IS NOT NULL""",
    "nodes": """
        SELECT graph_id, id AS raw_id,
               sha256(json_object('id', id, 'file', source_file, 'location', source_location)
                        ::VARCHAR) AS id,
               CASE WHEN callable_class THEN 'class'
                    WHEN (graph_id, id) IN (SELECT (graph_id, target) FROM raw_edges
                                            WHERE relation = 'method') THEN 'method'
                    WHEN callable THEN 'function'
                    WHEN label = coalesce(string_split(source_file, '/')[-1], '') THEN 'module'
                    ELSE 'entity' END AS kind,
               label AS name, source_file AS path,
               CASE WHEN source_file IS NOT NULL THEN start_line END AS start_line,
               CASE WHEN source_file IS NOT NULL THEN end_line END AS end_line,
               CASE WHEN lost THEN 'AMBIGUOUS' ELSE tag END AS provenance,
               CASE WHEN NOT lost THEN coalesce(score, CASE WHEN tag = 'EXTRACTED' THEN 1.0 END)
                 END AS confidence,
               CASE WHEN lost THEN 'unresolved_source_location_or_confidence'
                    WHEN tag = 'AMBIGUOUS' THEN 'graphify_ambiguous_relationship' END AS reason,
               'structural_entity' AS rule
        FROM (SELECT *, source_file IS NULL OR (tag = 'INFERRED' AND score IS NULL) AS lost
              FROM raw_nodes)""",
    "resolved": """
        SELECT e.* EXCLUDE (source, target), s.id AS source, t.id AS target
        FROM raw_edges e
        JOIN nodes s ON s.graph_id = e.graph_id AND s.raw_id = e.source
        JOIN nodes t ON t.graph_id = e.graph_id AND t.raw_id = e.target""",
    "unresolved": """
        SELECT e.* FROM raw_edges e
        WHERE NOT EXISTS (FROM raw_nodes n WHERE n.graph_id = e.graph_id AND n.id = e.source)
           OR NOT EXISTS (FROM raw_nodes n WHERE n.graph_id = e.graph_id AND n.id = e.target)""",
    "edges": """
        SELECT graph_id,
               sha256(json_object('source', source, 'target', target, 'relation', named,
                                  'location', source_location, 'file', source_file)::VARCHAR)
                 AS id,
               source, target, named AS relation, source_file AS path,
               CASE WHEN source_file IS NOT NULL THEN start_line END AS start_line,
               CASE WHEN source_file IS NOT NULL THEN end_line END AS end_line,
               CASE WHEN lost THEN 'AMBIGUOUS' ELSE tag END AS provenance,
               CASE WHEN NOT lost THEN coalesce(score, CASE WHEN tag = 'EXTRACTED' THEN 1.0 END)
                 END AS confidence,
               CASE WHEN lost THEN 'unresolved_source_location_or_confidence'
                    WHEN tag = 'AMBIGUOUS' THEN 'graphify_ambiguous_relationship' END AS reason,
               relation AS rule
        FROM (SELECT *, source_file IS NULL OR (tag = 'INFERRED' AND score IS NULL) AS lost,
                     CASE relation WHEN 'method' THEN 'declares' WHEN 'imports_from' THEN 'imports'
                          ELSE relation END AS named
              FROM resolved)""",
    "edge_variants": """
        SELECT graph_id, id, count(DISTINCT coalesce(provenance, '') || '|' ||
                 coalesce(confidence::VARCHAR, '') || '|' || coalesce(reason, '') || '|' ||
                 rule) AS variants,
               any_value(source) AS source, any_value(target) AS target,
               any_value(relation) AS relation, any_value(path) AS path,
               any_value(start_line) AS start_line, any_value(end_line) AS end_line,
               min(provenance) AS provenance, min(confidence) AS confidence, min(reason) AS reason
        FROM edges GROUP BY graph_id, id""",
    "conflicted": """
        SELECT graph_id, min(id) AS edge FROM edge_variants WHERE variants > 1
        GROUP BY graph_id""",
    "unique_edges": """
        SELECT * FROM edge_variants
        WHERE graph_id NOT IN (SELECT graph_id FROM conflicted)""",
    "archive_members": """
        SELECT archive_id, entry_no,
               CASE WHEN l_partkey % 97 = 0 THEN '../x.py' WHEN l_partkey % 89 = 0 THEN 'a/CON.txt'
                    WHEN l_partkey % 83 = 0 THEN 'a//b.py'
                    WHEN l_suppkey % 4 = 0 THEN upper('src/m' || l_partkey % 50 || '.py')
                    ELSE 'src/m' || l_partkey % 50 || '.py' END AS name,
               file_size,
               CASE WHEN l_partkey % 103 = 0 THEN file_size // 200
                    ELSE file_size // (l_partkey % 20 + 1) END AS compress_size,
               CASE WHEN l_partkey % 101 = 0 THEN 'symlink' ELSE 'regular' END AS mode
        FROM (SELECT l_orderkey AS archive_id, l_partkey, l_suppkey,
                     floor(l_extendedprice)::BIGINT AS file_size,
                     row_number() OVER (PARTITION BY l_orderkey
                       ORDER BY l_linenumber, l_partkey, l_suppkey,
                         floor(l_extendedprice)) AS entry_no
              FROM lineitem)""",
    "member_paths": r"""
        SELECT *, string_split(regexp_replace(replace(name, '\', '/'), '/+$', ''), '/') AS parts,
               name = '' OR starts_with(replace(name, '\', '/'), '/') OR len(list_filter(
                 string_split(regexp_replace(replace(name, '\', '/'), '/+$', ''), '/'),
                 lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[ .]$')
                   OR regexp_matches(p, '[\x00-\x1f:<>"|?*]')
                   OR regexp_matches(upper(string_split(p, '.')[1]),
                                     '^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])$'))) > 0 AS unsafe
        FROM archive_members""",
    "source_files": """
        SELECT source AS archive_id,
               'p' || doc_id || '/' || CASE doc_id % 10 WHEN 0 THEN 'f.py' WHEN 1 THEN 'App.TSX'
                 WHEN 2 THEN 'node_modules/x.js' WHEN 3 THEN 'package.json' WHEN 4 THEN 'run'
                 WHEN 5 THEN 'x.min.js' WHEN 6 THEN '.env.local' WHEN 7 THEN 'readme.md'
                 WHEN 8 THEN 'build' ELSE 'Main.java' END AS path,
               CASE WHEN doc_id % 10 = 4 THEN '#!/usr/bin/env python' || chr(10) || text
                    ELSE text END AS content
        FROM documents""",
    "screened": r"""
        SELECT *, CASE
            WHEN len(list_filter(string_split(lower(path), '/'), lambda p: p IN (
              '.git', '.hg', '.svn', 'node_modules', 'vendor', 'dist', 'build', 'target', '.venv',
              'venv', '__pycache__', 'coverage', '.idea', '.vscode'))) > 0 THEN 'ignored_path'
            WHEN strlen(content) > 20000 THEN 'too_large'
            WHEN regexp_matches(path, '(\.min\.js|\.min\.css|\.generated\.ts)$') THEN 'generated'
            WHEN regexp_matches(path, '(^|/)\.env(\.[^/]*)?$') THEN 'environment'
            WHEN contains(content, chr(0)) THEN 'binary' END AS why
        FROM source_files""",
    "detected": r"""
        SELECT archive_id, path, strlen(content) AS byte_size,
               coalesce(why, CASE WHEN language IS NULL THEN 'no_language' END) AS ignore_reason,
               CASE WHEN why IS NULL THEN language END AS language,
               CASE WHEN why IS NULL AND language IS NOT NULL THEN evidence END AS evidence,
               CASE WHEN why IS NULL AND language IS NOT NULL THEN
                 greatest(1, len(string_split(content, chr(10)))
                             - ends_with(content, chr(10))::INT) END AS line_count
        FROM (SELECT *,
                CASE WHEN path LIKE '%/package.json' THEN 'javascript' WHEN path LIKE '%.py' THEN
                  'python' WHEN path ILIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.js' THEN
                  'javascript' WHEN path LIKE '%.java' THEN 'java'
                  WHEN path LIKE '%/run' AND starts_with(content, '#!') THEN 'python' END
                  AS language,
                CASE WHEN path LIKE '%/package.json' THEN 'manifest'
                     WHEN path LIKE '%/run' THEN 'shebang' ELSE 'extension' END AS evidence
              FROM screened)""",
    "runs": """
        SELECT event_id AS id, user_id AS submission_id, ts AS started_at,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status
        FROM events""",
    "arrivals": """
        SELECT user_id AS submission_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'report_pdf'
                    ELSE 'source_archive' END AS kind,
               event_id AS version_no, ts AS registered_at
        FROM events""",
}


def query(body: str) -> str:
    """``body`` with the expressions it needs in front of it."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    if not parts:
        return body
    rest = re.sub(r"^\s*WITH\s", ", ", body)
    return f"WITH RECURSIVE {', '.join(parts)} {rest}"
