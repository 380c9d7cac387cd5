"""DuckDB SQL of the lifecycle queries and of the random choice in replays."""

from __future__ import annotations

from ..operators.analytics import _primes
from ..sources.bind import TODAY
from .oracle import EVAL, FACTS, wal, with_
from .oracle import SQL as BASE

_PROJECT = "CASE WHEN project = 'src0' THEN 'global' ELSE project END"
_STORE = f"""live AS (SELECT {_PROJECT} AS project, slug, '---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || body AS content FROM facts WHERE doc_id % 10 <> 4),
old AS (SELECT {_PROJECT} AS project, unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN slug END, CASE WHEN doc_id % 9 = 0 OR doc_id % 7 = 0 THEN bare || '-2.md' END], lambda x: x IS NOT NULL)) AS archived, body FROM facts),
orders AS (SELECT CASE WHEN doc_id % 10 = 8 THEN 'elsewhere' ELSE project END AS own, slug, bare, CASE WHEN doc_id % 4 = 0 THEN 'out of date' END AS reason, CASE WHEN doc_id % 6 = 0 THEN 'k' || (doc_id + 1) END AS successor FROM facts WHERE doc_id % 2 = 0)"""

SQL: dict[str, str] = {
    "retire_facts": with_(
        FACTS,
        _STORE,
        f"""seen AS (SELECT o.*, l.project, l.content, EXISTS (SELECT 1 FROM old a WHERE a.project = l.project AND a.archived = o.slug) AS one, EXISTS (SELECT 1 FROM old a WHERE a.project = l.project AND a.archived = o.bare || '-2.md') AS two
  FROM orders o LEFT JOIN live l ON l.slug = o.slug AND l.project IN (o.own, 'global'))""",
        select=f"""SELECT own, slug, CASE WHEN project IS NULL THEN 'missing' ELSE 'retired' END AS outcome, project,
  CASE WHEN project IS NOT NULL THEN CASE WHEN NOT one THEN slug WHEN NOT two THEN bare || '-2.md' ELSE bare || '-3.md' END END AS archived,
  project || chr(31) || bare || CASE WHEN successor IS NULL THEN '' ELSE '>' || successor END || CASE WHEN reason IS NULL THEN '' ELSE ':out_of_date' END AS target,
  coalesce(length(content) + length('retired: {TODAY} ') + CASE WHEN reason IS NULL THEN 0 ELSE length('retire-reason: out of date ') END + CASE WHEN successor IS NULL THEN 0 ELSE length('superseded-by: ' || successor || ' ') END, 0)::INTEGER AS chars FROM seen""",
    ),
    "revive_facts": with_(
        FACTS,
        _STORE,
        """seen AS (SELECT o.own, o.slug, o.bare, a.project, a.body, EXISTS (SELECT 1 FROM live l WHERE l.project = a.project AND l.slug = o.slug) AS taken FROM orders o LEFT JOIN old a ON a.archived = o.slug AND a.project IN (o.own, 'global'))""",
        select="""SELECT own, slug, CASE WHEN project IS NULL THEN 'missing' WHEN taken THEN 'taken' ELSE 'revived' END AS outcome, CASE WHEN NOT taken THEN project END AS project, CASE WHEN NOT taken THEN project || chr(31) || bare END AS target,
  CASE WHEN NOT taken AND project IS NOT NULL THEN md5('---' || chr(10) || 'name: x' || chr(10) || '---' || chr(10) || body) END AS digest FROM seen""",
    ),
    "ablation_events": with_(
        FACTS,
        select=f"""SELECT '{TODAY}' AS date, 'ablate-start' AS event, project || chr(31) || bare || ':' || CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN doc_id % 5 ELSE 5 END AS target, 'cli' AS session FROM facts
UNION ALL SELECT '{TODAY}', 'ablate-stop', project || chr(31) || bare || ':manual', 'cli' FROM facts""",
    ),
    "plan_summary": f"SELECT CASE WHEN pruned THEN 'pruned' ELSE 'kept' END AS action, count(*) AS n FROM ({BASE['prune_plan']}) GROUP BY 1",
    "ab_random": with_(
        wal(),
        EVAL,
        f"""pool AS (SELECT slug, row_number() OVER (ORDER BY md5(slug), slug) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT target AS slug FROM wal)),
drawn AS (SELECT session, len(useful) AS size, unnest(useful) AS slug, {_primes()}[('0x' || substr(md5('1:' || session), 1, 8))::BIGINT % 16 + 1]::BIGINT AS a, ('0x' || substr(md5('1:' || session), 9, 8))::BIGINT AS b FROM ses),
placed AS (SELECT session, size, (a * place + b) % n AS spot FROM drawn JOIN pool USING (slug))""",
        select="SELECT k, count(*) AS sessions, round(avg(h / size), 6) AS recall FROM (SELECT k, session, size, count(*) FILTER (WHERE spot < k) AS h FROM placed, (SELECT unnest([3, 5, 8, 12])::INTEGER AS k) GROUP BY ALL) GROUP BY k",
    ),
}
