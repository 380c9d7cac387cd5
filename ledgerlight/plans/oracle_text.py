"""DuckDB SQL of the queries that apply text functions to whole tables."""

from __future__ import annotations

from .oracle import FACTS
from .oracle import SQL as BASE
from .oracle import with_


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


_LIST = r"""'[ ' || body || ', "' || slug || '", '''', '' x '',' || chr(10) || '''' || skill || ''']' || chr(10)"""
_FIRST = r"""string_split('"' || name || '"', chr(10))[1]"""

SQL: dict[str, str] = {
    "list_parse": with_(
        FACTS,
        select=rf"""SELECT slug, array_to_string(list_filter(list_transform(string_split(regexp_replace({strip(_LIST)}, '^\[|\]$', '', 'g'), ','),
  lambda x: regexp_replace({strip("x")}, '^["'']+|["'']+$', '', 'g')), lambda x: x <> ''), '/') AS items FROM facts""",
    ),
    "frontmatter": with_(
        FACTS,
        select=rf"""SELECT slug, trim({strip(_FIRST)}, '"''') AS name, 'kw' || (doc_id % 13) || ', ' || skill AS keywords, status, project || '/b c' AS domains, 4 AS n_keys,
  length({strip("body")})::INTEGER AS body_chars FROM facts""",
    ),
    "fact_scan": with_(
        FACTS,
        """made AS (SELECT *, CASE doc_id % 50 WHEN 0 THEN 'MEMORY.md' WHEN 1 THEN 'k' || doc_id || '.txt' ELSE slug END AS file FROM facts),
files AS (SELECT *, concat_ws(chr(10), 'name: fact ' || doc_id, 'type: ' || type, 'created: ' || chr(39) || created || chr(39), 'domains: [x, ' || project || ']', 'recurrence: ' || CASE WHEN doc_id % 4 = 3 THEN 'many' ELSE (doc_id % 4)::VARCHAR END) AS head FROM made)""",
        select=rf"""SELECT '/m/' || project || '/' || file AS path, file AS slug, 'fact ' || doc_id AS name, type, created, '' AS status, 'x/' || project AS domains, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 4 END AS recurrence,
  sha256(concat_ws(chr(10), '---', head, '---', body)) AS content_sha, md5({strip("body")}) AS body FROM files WHERE doc_id % 50 > 1""",
    ),
    "guarded_path": with_(
        FACTS,
        """paths AS (SELECT CASE doc_id % 5 WHEN 0 THEN '/home/u/.agent/memory/' WHEN 1 THEN '/home/u/.agent/global/sub/' WHEN 2 THEN '/home/u/projects/' || project || '/memory/'
  WHEN 3 THEN '/etc/' ELSE '/projects/memory/' END || slug AS path, slug, doc_id FROM facts)""",
        select="SELECT path, CASE doc_id % 5 WHEN 0 THEN slug WHEN 1 THEN 'sub/' || slug WHEN 2 THEN slug END AS rel FROM paths",
    ),
    "sanitize": with_(
        FACTS,
        select=r"""SELECT slug, regexp_replace(body, '[|\r\n]', '_', 'g') AS sanitized, CASE WHEN body = '' THEN '_' ELSE regexp_replace(body, '[^A-Za-z0-9._-]', '_', 'g') END AS safe, bare FROM facts""",
    ),
    "root_cause": with_(
        FACTS,
        """firsts AS (SELECT slug, string_split(ltrim(body, chr(10) || ' '), chr(10)) AS l FROM facts),
causes AS (SELECT slug, regexp_replace(l[1] || CASE WHEN len(l) = 1 THEN '''' ELSE '' END, '^["'']?(.+?)["'']?\\s*$', '\\1') AS v FROM firsts)""".replace("\\\\", "\\"),
        select=f"SELECT slug, CASE WHEN length({strip('v')}) >= 10 THEN {strip('v')} END AS cause FROM causes",
    ),
    "guard": f"""WITH hits AS ({BASE["secrets_scan"]}) SELECT d.doc_id AS write_id, '/home/u/projects/' || source || '/memory/k' || d.doc_id || '.md' AS path, by_key OR by_value > 0 AS blocked
FROM documents d JOIN hits USING (doc_id)""",
}
