"""DuckDB SQL of what is shown: capped bodies, rendered rankings, JSON lines, ignore rules."""

from __future__ import annotations

from ..schema import MAX_BODY_BYTES, MAX_TOTAL_BYTES
from ..sources.bind import TODAY
from .oracle import FACTS, FULL_HEAD, RANKED, STALE, TERMS, ranked, tokens
from .oracle import SQL as BASE
from .oracle import with_


def capped(body: str, limit: int = MAX_BODY_BYTES) -> str:
    """The longest whole characters in the first bytes, and a mark; short bodies as they are."""
    cut = ", ".join(f"try(decode(encode({body})[1:{limit - k}]::BLOB))" for k in range(4))
    return rf"CASE WHEN strlen({body}) <= {limit} THEN {body} ELSE regexp_replace(coalesce({cut}), '[ \n]+$', '') || chr(10) || chr(10) || '…(truncated)' END"


_CHUNK = f"chr(10) || '## ' || CASE WHEN name = '' THEN slug ELSE name END || chr(10) || CASE WHEN body = '' THEN '' ELSE {capped('body')} || chr(10) END"


def shown(of: str, by: str, header: str) -> str:
    """Rows of a ranking while their chunks, in order, fit behind the header."""
    return f"""chunks AS (SELECT {by}, rank, slug, strlen({_CHUNK}) AS bytes FROM {of}),
sums AS (SELECT *, sum(bytes) OVER (PARTITION BY {by} ORDER BY rank) + {len(header)} AS so_far FROM chunks)"""


_RECALL = f"""pulled AS (SELECT r.*, a.status, a.type, f.name, f.description, f.body, f.bare FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS rank, slug, project, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, project) AS rank FROM (SELECT * REPLACE (round(score, 6) AS score) FROM recalled WHERE overlap > 0)) q
  WHERE rank <= 12 AND CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 6 <> 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8) r JOIN aged a USING (slug) JOIN facts f USING (slug))"""
_STALE = "CASE WHEN status = 'stale' THEN ' [stale]' ELSE '' END"
_ANSWER = f"""CASE WHEN rank = 1 THEN '## ' || CASE WHEN name = '' THEN slug ELSE name END || ' (' || type || ', score ' || printf('%.2f', score) || ')' || {_STALE} || chr(10) || CASE WHEN body = '' THEN '' ELSE {capped('body')} || chr(10) END
  ELSE rank || '. ' || slug || ' (' || printf('%.2f', score) || ')' || {_STALE} || CASE WHEN description = '' THEN '' ELSE ' — ' || description END || chr(10) || '   ' || project || '/' || slug || chr(10) END"""
_GRAVE = """'  - ' || bare || ' [retired ' || created || ' → ' || CASE WHEN doc_id % 8 = 1 THEN 'k1' ELSE 'no successor' END || ']' || CASE WHEN doc_id % 3 = 0 THEN ' (reason: merged)' ELSE '' END || chr(10) || '    ' || project || '/' || slug || chr(10)"""

SQL: dict[str, str] = {
    "recall_render": with_(
        RANKED,
        STALE,
        ranked("aged", "recalled"),
        _RECALL,
        f"""graves AS (SELECT DISTINCT r.query_id, r.own, g.* FROM terms t JOIN requests r USING (query_id) JOIN (SELECT slug, bare, doc_id, created, CASE WHEN project = 'src0' THEN 'global' ELSE project END AS project, unnest({tokens(FULL_HEAD)}) AS term FROM facts WHERE doc_id % 4 = 1) g
  ON g.term = t.term AND g.project IN (r.own, 'global')),
stones AS (SELECT DISTINCT query_id, own, slug, project, {_GRAVE} AS text FROM graves)""",
        select=f"""SELECT query_id, 1 AS part, rank::INTEGER AS place, md5({_ANSWER}) AS digest FROM pulled
UNION ALL SELECT query_id, 1, 1, md5('no matches' || chr(10)) FROM requests WHERE query_id NOT IN (SELECT query_id FROM pulled)
UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY project <> own, slug)::INTEGER, md5(text) FROM stones""",
    ),
    "recall_events": with_(RANKED, STALE, ranked("aged", "recalled"), _RECALL, select=f"SELECT DISTINCT '{TODAY}' AS date, 'recall' AS event, project || chr(31) || slug AS target, 'cli' AS session FROM pulled WHERE rank = 1"),
    "keyword_query": with_(
        FACTS,
        select=f"""SELECT DISTINCT query_id, unnest({tokens("concat_ws(' ', b.text, 'src' || (item_id % 20) || '-service', f.description)")}) AS term FROM (SELECT item_id AS query_id, * FROM benchmark) b LEFT JOIN facts f ON f.doc_id = b.item_id""",
    ),
    "cap_body": with_(FACTS, select=f"SELECT slug, strlen({capped('body')})::INTEGER AS bytes FROM facts"),
    "inject_render": with_(
        RANKED,
        "best AS (SELECT r.*, f.name, f.body FROM ranked r JOIN facts f USING (slug) WHERE rank <= 8)",
        shown("best", "query_id", "# Memory Context\n"),
        select=f"SELECT query_id, rank::INTEGER AS rank, slug, bytes::INTEGER AS bytes FROM sums WHERE so_far <= {MAX_TOTAL_BYTES}",
    ),
    "skill_render": f"""WITH best AS (SELECT t.skill, t.rank, t.slug, substr(text, 1, 40) AS name, text AS body FROM ({BASE["skill_topk"]}) t JOIN documents d ON t.slug = 'k' || d.doc_id || '.md'),
{shown("best", "skill", "# Skill Learnings" + chr(10))}
SELECT skill, rank::INTEGER AS rank, slug, bytes::INTEGER AS bytes FROM sums WHERE so_far <= {MAX_TOTAL_BYTES}""",
    "envelope_json": with_(
        RANKED,
        select="SELECT query_id, to_json({'rank': rank, 'slug': slug, 'project': project, 'overlap': overlap, 'score': round(score, 6)})::VARCHAR AS json FROM ranked WHERE rank <= 8",
    ),
    "ignore_match": with_(FACTS, select="SELECT skill || '/' || slug AS path, skill = 'spark' AND NOT starts_with(slug, 'k1') AS ignored FROM facts"),
}
