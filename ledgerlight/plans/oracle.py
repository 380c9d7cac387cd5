"""DuckDB SQL of the registered queries: an independent statement of what each returns."""

from __future__ import annotations

from ..functions.text import SECRET_KEY, SECRET_VALUES
from ..schema import ACTIVE_EVENTS, CLOSING_EVENTS, DECAY_DAYS, ERROR_EVENTS, FACT_TYPES, STOPWORDS, TAIL_BYTES
from ..sources.bind import PROJECT, TODAY


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_STOP = _in(dict.fromkeys(STOPWORDS))


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nd}}_]{{3,}}'), lambda w: w NOT IN {_STOP})"


_RULES = [
    ("r = 0", "'inject-agg'", "bt", "(1 + u % 20)::VARCHAR"),
    ("r = 1", "'recall'", "bt", "bs"),
    ("r = 2", "'retire'", "qs || '>k' || ((k + 1) % 25) || ':superseded'", "'cli'"),
    ("r = 3", "'revive'", "qs", "'cli'"),
    ("r = 4", "'candidate-confirmed'", "qs", "bs"),
    ("r = 5", "'ablate-start'", "qs || ':' || (2 + u % 4)", "'cli'"),
    ("r = 6", "'ablate-stop'", "qs || ':manual'", "'cli'"),
    ("r BETWEEN 7 AND 12", "'holdout-skip'", "qs", "bs"),
    ("r BETWEEN 13 AND 15", "'holdout-hit'", "qs", "bs"),
    ("r = 16", "'holdout-miss'", "qs", "bs"),
    ("r = 17", "'session-metrics'", "'domains:d' || (u % 5) || ',d' || (u % 3) || ',' || mb", "bs"),
    ("r = 18", "'session-metrics'", "'d' || (u % 5)", "mb"),
    ("r = 19", "'session-close'", "bs", "bs"),
    ("r = 20", "'trigger-silent-retro'", "bt", "bs"),
    ("r = 21", "'outcome-new'", "'k' || k", "bs"),
    ("r = 22", "'clean-session'", "'k' || k", "bs"),
    ("r = 23", "'strategy-used'", "'k' || k", "bs"),
    ("r = 24", "'strategy-gap'", "'k' || k", "bs"),
    ("r = 25", "'evidence-empty'", "'k' || k", "bs"),
    ("r = 26", "'schema-error'", "'k' || k", "bs"),
    ("r = 27", "'mystery-event'", "bt", "bs"),
]
_BAD = [("r = 28", "be", "bt", "bs || '|x'"), ("r = 30", "'Bad Event'", "bt", "bs"), ("r = 31", "be", "bt", "''")]


def wal(malformed: bool = False) -> str:
    rules = _RULES + (_BAD if malformed else [])
    case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + f" ELSE {other} END"
    date = "CASE WHEN r = 29 THEN '2024/01/02' ELSE date END" if malformed else "date"
    return f"""own AS (SELECT doc_id AS k, source FROM documents WHERE doc_id < 25),
e0 AS (SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d') AS date, CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS k, user_id % 30 AS u, event_id % 97 AS r, event_type FROM events),
e1 AS (SELECT e0.*, source || chr(31) || 'k' || e0.k AS qs,
  CASE WHEN u = 7 THEN 'inject' ELSE CASE event_type WHEN 'view' THEN 'inject' WHEN 'click' THEN 'trigger-useful' WHEN 'error' THEN 'trigger-silent' WHEN 'purchase' THEN 'outcome-positive' WHEN 'signup' THEN 'outcome-negative' END END AS be,
  CASE WHEN line_no % 4 <> 0 THEN source || chr(31) || 'k' || e0.k || '.md' ELSE 'k' || e0.k END AS bt,
  's' || u || '-' || date AS bs, 'error_count:' || (u % 4) || ',tool_calls:' || e0.k || ',duration:60s' AS mb
  FROM e0 LEFT JOIN own ON e0.k = own.k),
wal AS (SELECT line_no, {date} AS date, {case(1, "be")} AS event, {case(2, "bt")} AS target, {case(3, "bs")} AS session FROM e1)"""


def keyed(trim_all: bool = False, name: str = "keyed") -> str:
    cond = "true" if trim_all else "event IN ('retire', 'revive', 'ablate-start', 'ablate-stop')"
    return f"""{name}0 AS (SELECT *, CASE WHEN contains(target, chr(31)) THEN string_split(target, chr(31))[1] END AS project, CASE WHEN contains(target, chr(31)) THEN string_split(target, chr(31))[2] ELSE target END AS rest FROM wal),
{name}1 AS (SELECT *, regexp_replace(CASE WHEN {cond} THEN regexp_extract(rest, '^[^>:]*') ELSE rest END, '\\.md$', '') AS slug FROM {name}0),
{name} AS (SELECT *, CASE WHEN project IS NOT NULL THEN project || chr(31) || slug ELSE slug END AS key FROM {name}1)"""


FACTS = f"""facts AS (SELECT 'k' || doc_id || '.md' AS slug, source AS project, substr(text, 1, 40) AS name, substr(text, 41, 160) AS description,
  {list(FACT_TYPES)}[doc_id % 9 + 1] AS type, strftime(DATE '2024-01-01' - CAST(doc_id % 120 AS INTEGER), '%Y-%m-%d') AS created,
  CASE doc_id % 10 WHEN 0 THEN 'pinned' WHEN 1 THEN 'candidate' ELSE 'active' END AS status,
  ['kw' || (doc_id % 13)] AS keywords, [lang] AS domains, [substr(text, 1, 12)] AS evidence,
  CASE WHEN doc_id % 3 = 0 THEN 'spark' ELSE 'sql' END AS skill, CASE WHEN doc_id % 7 = 0 THEN 'ambient' ELSE '' END AS precision_class,
  doc_id % 4 AS recurrence, doc_id % 5 AS success_count, sha256(text) AS content_sha, text AS body, doc_id, 'k' || doc_id AS bare FROM documents)"""

REQUESTS = "requests AS (SELECT item_id AS query_id, text, 'src' || (item_id % 20) AS own FROM benchmark)"
TERMS = f"terms AS (SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM requests)"
_FULL = "concat_ws(' ', name, description, array_to_string(keywords, ' '), array_to_string(domains, ' '), body)"
#: What tombstones are searched for.
FULL_HEAD = _FULL.replace(", body", "")
KEYWORD = f"keyword AS (SELECT slug, project, term, count(*)::DOUBLE AS weight FROM (SELECT slug, project, unnest({tokens(_FULL)}) AS term FROM facts) GROUP BY ALL)"

AGG = """agg AS (SELECT key,
  sum(CASE WHEN event IN ('inject', 'recall') THEN 1 WHEN event = 'inject-agg' THEN greatest(coalesce(try_cast(session AS BIGINT), 1), 1) ELSE 0 END)::BIGINT AS injects,
  count(*) FILTER (WHERE event = 'outcome-positive') AS pos, count(*) FILTER (WHERE event = 'outcome-negative') AS neg,
  min(date) AS created, max(date) FILTER (WHERE event IN ('inject', 'recall', 'inject-agg')) AS last_inject,
  bool_or(event = 'candidate-confirmed') AS confirmed,
  coalesce(arg_max(event, line_no) FILTER (WHERE event IN ('retire', 'revive')) = 'retire', false) AS retired FROM keyed GROUP BY key)"""
VERDICTS = """verdicts AS (SELECT key, session, bool_or(event = 'trigger-useful') AS useful, min(line_no) AS first_line FROM keyed
  WHERE event IN ('trigger-useful', 'trigger-silent', 'trigger-silent-retro') GROUP BY key, session)"""
HOLD = """h0 AS (SELECT key, max(line_no) AS s FROM keyed WHERE event = 'ablate-start' GROUP BY key),
h1 AS (SELECT k.key, min(line_no) AS e FROM keyed k JOIN h0 ON k.key = h0.key AND line_no > s WHERE event = 'ablate-stop' GROUP BY k.key),
hold AS (SELECT h0.key, (SELECT coalesce(nullif(try_cast(regexp_extract(target, ':([^:]*)$', 1) AS BIGINT), 0), 5) FROM keyed x WHERE x.line_no = h0.s) AS n, h1.e IS NOT NULL AS stopped FROM h0 LEFT JOIN h1 USING (key)),
skips AS (SELECT DISTINCT k.key, k.session FROM keyed k JOIN h0 ON k.key = h0.key AND k.line_no > h0.s LEFT JOIN h1 ON k.key = h1.key WHERE k.event = 'holdout-skip' AND (h1.e IS NULL OR k.line_no < h1.e))"""
PROJECTION = """fk AS (SELECT project, slug, project || chr(31) || bare AS key, 0 AS kr FROM facts UNION ALL SELECT project, slug, bare, 1 FROM facts),
fa AS (SELECT fk.project, fk.slug, sum(injects) AS injects, sum(pos) AS pos, sum(neg) AS neg, min(created) AS first_seen, max(last_inject) AS last_inject, bool_or(confirmed) AS confirmed FROM fk JOIN agg USING (key) GROUP BY ALL),
fv0 AS (SELECT project, slug, session, bool_or(useful) AS useful FROM fk JOIN verdicts USING (key) GROUP BY ALL),
fv AS (SELECT project, slug, count(*) FILTER (WHERE useful) AS useful, count(*) FILTER (WHERE NOT useful) AS silent FROM fv0 GROUP BY ALL),
fh AS (SELECT project, slug, arg_min(n, kr) AS n, bool_or(stopped) AS stopped FROM fk JOIN hold USING (key) GROUP BY ALL),
fs AS (SELECT project, slug, count(DISTINCT session) AS used FROM fk JOIN skips USING (key) GROUP BY ALL),
hist AS (SELECT f.*, coalesce(fa.injects, 0)::BIGINT AS injects, coalesce(fa.pos, 0) + coalesce(fv.useful, 0) AS p, coalesce(fa.neg, 0) + coalesce(fv.silent, 0) AS m, fa.first_seen, fa.last_inject,
  coalesce(fa.confirmed, false) OR coalesce(fa.pos, 0) + coalesce(fv.useful, 0) > 0 AS graduated,
  CASE WHEN fh.n IS NULL OR fh.stopped THEN 0 ELSE greatest(fh.n - coalesce(fs.used, 0), 0) END::BIGINT AS holdout_remaining
  FROM facts f LEFT JOIN fa USING (project, slug) LEFT JOIN fv USING (project, slug) LEFT JOIN fh USING (project, slug) LEFT JOIN fs USING (project, slug)),
proj AS (SELECT slug, content_sha, type, name, description, project, domains, coalesce(nullif(created, ''), first_seen) AS created, last_inject AS last_injected, injects AS ref_count,
  CASE WHEN status = 'pinned' THEN 'pinned' WHEN status = 'candidate' AND NOT graduated THEN 'candidate' ELSE 'active' END AS status,
  (p + 1) / (p + CASE WHEN precision_class = 'ambient' THEN 0 ELSE m END + 2) AS effectiveness, holdout_remaining FROM hist)"""


def recency(last: str, created: str, today: str) -> str:
    day = f"CASE WHEN coalesce({last}, '') <> '' THEN {last} ELSE {created} END"
    days = f"date_diff('day', CASE WHEN regexp_full_match({day}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({day} AS DATE) END, {today})"
    return f"CASE WHEN {days} IS NULL THEN 0 ELSE 1 / (1 + greatest({days}, 0) / 30.0) END"


_T = f"DATE '{TODAY}'"
STATIC = f"log10(1 + ref_count) * least(greatest(2 * effectiveness, 0), 1) + 2 * {recency('last_injected', 'created', _T)} + 2 * effectiveness + CASE WHEN project = '{PROJECT}' THEN 1 ELSE 0 END"
OVERLAP = "over AS (SELECT query_id, slug, count(DISTINCT term) AS overlap FROM terms JOIN keyword USING (term) GROUP BY query_id, slug)"
STALE = f"""stale_hit AS (SELECT DISTINCT slug FROM proj WHERE status = 'active' AND type NOT IN ('continuity', 'project')
  AND date_diff('day', coalesce(try_cast(last_injected AS DATE), try_cast(created AS DATE)), {_T}) > CASE type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DECAY_DAYS.items())} ELSE 90 END),
aged AS (SELECT p.* REPLACE (CASE WHEN p.status = 'active' AND s.slug IS NOT NULL THEN 'stale' ELSE p.status END AS status) FROM proj p LEFT JOIN stale_hit s ON p.slug = s.slug)"""
ALL = ",\n".join([wal(), keyed(), FACTS, AGG, VERDICTS, HOLD, PROJECTION])
#: The score's part without terms and own project; facts of src0 are the global store's.
_BASE = STATIC.rsplit(" + CASE", 1)[0]
_BONUS = "CASE WHEN s.project = r.own AND s.project <> 'global' THEN 1.0 ELSE 0 END"


def ranked(of: str, name: str) -> str:
    """CTEs that end in ``name``: every request with every row of ``of`` in its scope, and overlap and score."""
    return f"""{name}_facts AS (SELECT *, {_BASE} AS static FROM (SELECT * REPLACE (CASE WHEN project = 'src0' THEN 'global' ELSE project END AS project) FROM {of})),
{name} AS (SELECT r.query_id, s.slug, s.project, s.status, coalesce(o.overlap, 0) AS overlap, 3 * coalesce(o.overlap, 0) + (s.static + {_BONUS}) AS score
  FROM requests r JOIN {name}_facts s ON s.project IN (r.own, 'global') LEFT JOIN over o ON o.query_id = r.query_id AND o.slug = s.slug)"""


RANKED = ",\n".join([ALL, REQUESTS, TERMS, KEYWORD, OVERLAP, ranked("proj", "scored")]) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, project) AS rank FROM scored)"""
JSONL = """lines AS (SELECT 'c' || conv_id AS session, turn, role, text, 1704067200 + conv_id * 3600 + turn * 60 AS t FROM conversations)"""
TEXTS = """texts AS (SELECT session, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM lines WHERE role = 'assistant' AND text <> '' GROUP BY session)"""
METRICS = """metrics AS (SELECT session, count(*) FILTER (WHERE role = 'assistant' AND turn % 2 = 0) AS tool_calls, count(*) FILTER (WHERE role <> 'assistant' AND turn % 2 = 0 AND turn % 3 = 0) AS errors,
  greatest(arg_max(t, turn) - arg_min(t, turn), 0)::BIGINT AS seconds FROM lines GROUP BY session)"""
DELIVERED = """delivered AS (SELECT DISTINCT c.session, f.slug, f.name, f.evidence FROM (SELECT DISTINCT session, CAST(substr(session, 2) AS BIGINT) AS n FROM lines) c JOIN facts f ON f.doc_id % 50 = c.n % 50)"""
CLASSIFY = """classified AS (SELECT d.session, d.slug, coalesce(
  len(list_filter(d.evidence, lambda e: e <> '' AND contains(lower(coalesce(t.text, '')), lower(e)))) > 0 OR contains(lower(coalesce(t.text, '')), regexp_replace(d.slug, '\\.md$', ''))
  OR (d.name <> '' AND contains(lower(coalesce(t.text, '')), lower(d.name))), false) AS useful FROM delivered d LEFT JOIN texts t USING (session))"""
EVAL = "ses AS (SELECT session, min(date) AS date, list_sort(list(DISTINCT target)) AS useful FROM wal WHERE event = 'trigger-useful' GROUP BY session)"
SIGNALS = """sig AS (SELECT d.date, w.target AS slug, sum(CASE WHEN event = 'inject' THEN 1 WHEN event = 'inject-agg' THEN greatest(coalesce(try_cast(session AS BIGINT), 1), 1) ELSE 0 END)::BIGINT AS ref_count,
  count(*) FILTER (WHERE event = 'outcome-positive') AS pos, count(*) FILTER (WHERE event = 'outcome-negative') AS neg, max(w.date) FILTER (WHERE event IN ('inject', 'inject-agg')) AS last_inject
  FROM (SELECT DISTINCT date FROM ses) d JOIN wal w ON w.date < d.date WHERE event IN ('inject', 'inject-agg', 'outcome-positive', 'outcome-negative') GROUP BY d.date, w.target)"""
TRIM = keyed(True, "kt")
RUNS0 = """r0 AS (SELECT {k} AS g, max(line_no) AS s FROM kt WHERE event = 'ablate-start' GROUP BY {k}),
r1 AS (SELECT kt.*, r0.s, r0.g FROM kt JOIN r0 ON kt.{k} = r0.g AND kt.line_no >= r0.s),
r2 AS (SELECT g, session, bool_or(event = 'holdout-skip') AS skip, bool_or(event = 'holdout-hit') AS hit FROM r1 WHERE event IN ('ablate-start', 'ablate-stop', 'holdout-skip', 'holdout-hit') GROUP BY g, session),
runs AS (SELECT r1.g, max(CASE WHEN event = 'ablate-start' THEN coalesce(nullif(try_cast(regexp_extract(target, ':([^:]*)$', 1) AS BIGINT), 0), 5) END) AS requested,
  arg_max(CASE WHEN ends_with(target, ':expired') THEN 'expired' ELSE 'manual' END, line_no) FILTER (WHERE event = 'ablate-stop') AS stopped,
  max(o.observed) AS observed, max(o.hits) AS hits FROM r1 JOIN (SELECT g, count(*) FILTER (WHERE skip) AS observed, count(*) FILTER (WHERE skip AND hit) AS hits FROM r2 GROUP BY g) o ON r1.g = o.g GROUP BY r1.g)"""
STREAK = """vt AS (SELECT key, session, bool_or(event = 'trigger-useful') AS useful, min(line_no) AS first_line FROM kt WHERE event IN ('trigger-useful', 'trigger-silent') GROUP BY key, session),
streak AS (SELECT key, bool_and(useful) AND count(*) = 5 AS streak FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_line DESC) AS rn FROM vt) WHERE rn <= 5 GROUP BY key)"""
METRIC_ROWS = """mrows AS (SELECT line_no, session, CASE WHEN starts_with(target, 'domains:') THEN regexp_replace(substr(target, 9), ',[A-Za-z0-9_]+:.*$', '') ELSE target END AS domains,
  coalesce(try_cast(regexp_extract(CASE WHEN starts_with(target, 'domains:') THEN target ELSE session END, 'error_count:(\\d+)', 1) AS BIGINT), 0) AS error_count FROM wal WHERE event = 'session-metrics')"""
CANDIDATES = """ct AS (SELECT key, count(DISTINCT session) FILTER (WHERE event = 'trigger-useful') AS u, count(DISTINCT session) FILTER (WHERE event = 'trigger-silent') AS s, bool_or(event = 'candidate-confirmed') AS c FROM keyed GROUP BY key),
flagged AS (SELECT f.slug, f.project, CASE WHEN q.key IS NOT NULL THEN q.s ELSE b.s END AS silent FROM facts f LEFT JOIN ct q ON q.key = f.project || chr(31) || f.bare LEFT JOIN ct b ON b.key = f.bare
  WHERE f.status = 'candidate' AND CASE WHEN q.key IS NOT NULL THEN q.u = 0 AND NOT q.c AND q.s >= 5 ELSE b.u = 0 AND NOT b.c AND b.s >= 5 END)"""
QUIET = r"quiet AS (SELECT * REPLACE (CASE WHEN regexp_matches(target, 'k(11|21)(\.md)?$') AND event IN ('trigger-useful', 'candidate-confirmed') THEN 'trigger-silent' ELSE event END AS event) FROM wal)"
QUANTA = f"""oi AS (SELECT session, count(*) AS n FROM wal WHERE event = 'inject' AND date >= strftime({_T} - 30, '%Y-%m-%d') GROUP BY session),
oc AS (SELECT DISTINCT session FROM wal WHERE event IN {_in(CLOSING_EVENTS)} AND date >= strftime({_T} - 30, '%Y-%m-%d')),
quanta AS (SELECT count(*) AS sessions, count(*) FILTER (WHERE oc.session IS NULL) AS open, coalesce(sum(n) FILTER (WHERE oc.session IS NULL), 0)::BIGINT AS lost_injects FROM oi LEFT JOIN oc USING (session))"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence; ``a`` has 126 characters at most, as its rows are bits of one number."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT"
    rows = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({rows}) END"


def token_set(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{Nd}}_]', ' ', 'g'), '\\s+'), lambda w: w <> '')))"


def set_ratio(pairs: str, keep: str) -> str:
    """CTEs that end in ``rated``: the columns ``keep`` of ``pairs`` (a, b: texts, the shorter one b) and their token-set similarity."""
    return f"""r0 AS (SELECT {keep}, {token_set('a')} AS ta, {token_set('b')} AS tb FROM {pairs}),
r1 AS (SELECT *, array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ') AS s, array_to_string(list_filter(ta, lambda w: NOT list_contains(tb, w)), ' ') AS x,
  array_to_string(list_filter(tb, lambda w: NOT list_contains(ta, w)), ' ') AS y FROM r0),
r2 AS (SELECT *, length(s) AS ls, length(x) AS lx, length(y) AS ly, (s <> '')::INT AS sep FROM r1),
rated AS (SELECT {keep}, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE WHEN s <> '' AND (x = '' OR y = '') THEN 100.0::DOUBLE ELSE greatest(
  100.0::DOUBLE * (1 - (lx + ly - 2 * ({lcs('y', 'x')})) / (2 * (ls + sep) + lx + ly)::DOUBLE),
  CASE WHEN s <> '' THEN 100.0::DOUBLE * (1 - (sep + lx) / (2 * ls + sep + lx)::DOUBLE) ELSE 0 END, CASE WHEN s <> '' THEN 100.0::DOUBLE * (1 - (sep + ly) / (2 * ls + sep + ly)::DOUBLE) ELSE 0 END) END AS score FROM r2)"""


NEIGHBOURS = "neighbours AS (SELECT slug, name, lead(name) OVER (PARTITION BY project ORDER BY doc_id) AS other FROM facts QUALIFY other IS NOT NULL)"
#: Facts just written against the mistakes before them; every pair is rated.
MERGES = f"""mistakes AS (SELECT project, slug, name AS cause, CASE WHEN doc_id % 7 <> 0 THEN recurrence END AS recurrence, doc_id, doc_id // 9 % 3 = 0 AS fresh FROM facts WHERE type = 'mistake'),
mpairs AS (SELECT n.project, n.slug, k.project AS to_project, k.slug AS to_slug, k.doc_id AS ord, n.cause AS a, k.cause AS b FROM mistakes n JOIN mistakes k ON n.fresh AND NOT k.fresh AND length(n.cause) >= 10 AND length(k.cause) >= 10),
{set_ratio('mpairs', 'project, slug, to_project, to_slug, ord')},
matches AS (SELECT * FROM rated WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY project, slug ORDER BY score DESC, ord) = 1)"""

TIMED = f"timed AS (SELECT w.*, epoch_us(e.ts) // 1000 AS ms FROM wal w JOIN events e ON e.event_id = w.line_no), now AS (SELECT epoch_us(TIMESTAMP '{TODAY} 00:00:00') // 1000 AS n)"
#: Milliseconds of 24 hours.
_DAY = 86_400_000

SQL: dict[str, str] = {
    "append_probe": with_(wal(), "lines AS (SELECT line_no, concat_ws('|', date, event, target, session) AS value FROM wal WHERE line_no % 3 <> 0)",
        f"""ends AS (SELECT value, sum(strlen(value) + 1) OVER (ORDER BY line_no DESC) AS so_far, sum(strlen(value) + 1) OVER () AS total FROM lines),
keys AS (SELECT DISTINCT concat_ws('|', event, target) AS key FROM wal WHERE line_no % 3 = 0)""", select=f"""SELECT key, NOT EXISTS (SELECT 1 FROM ends WHERE (total <= {TAIL_BYTES} OR so_far < {TAIL_BYTES}) AND contains(value, key)) AS fresh FROM keys"""),
    "retro_silent": with_(wal(), TIMED, select=f"""SELECT strftime(make_timestamp((due * 1000)::BIGINT), '%Y-%m-%d') AS date, 'trigger-silent-retro' AS event, target, session
FROM (SELECT session, target, min(ms) + {_DAY} AS due FROM timed WHERE event = 'inject' GROUP BY ALL) i, now WHERE due <= n
  AND NOT EXISTS (SELECT 1 FROM timed c WHERE c.session = i.session AND c.event IN {_in(CLOSING_EVENTS)} AND c.ms <= i.due)"""),
    "list_lives": with_(wal(), TIMED, select=f"""SELECT session, kind, max(ms)::BIGINT AS last, array_to_string(list_sort(list(DISTINCT slug)), ',') AS slugs, any_value(n) - max(ms) <= any_value(life) AS live
FROM (SELECT *, sum(ended) OVER (PARTITION BY session, kind ORDER BY ms ROWS UNBOUNDED PRECEDING) AS number
  FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY session, kind ORDER BY ms) > life THEN 1 ELSE 0 END AS ended
    FROM (SELECT session, target AS slug, ms, n, CASE WHEN event IN ('inject', 'recall') THEN 'injected' WHEN event = 'holdout-skip' THEN 'holdout' ELSE 'skill' END AS kind, CASE WHEN event = 'strategy-used' THEN {_DAY} ELSE 7 * {_DAY} END AS life
      FROM timed, now WHERE event IN ('inject', 'recall', 'holdout-skip', 'strategy-used') AND ms <= n))) GROUP BY session, kind, number"""),
    "indel_distance": with_(FACTS, NEIGHBOURS, select=f"SELECT slug, (length(name) + length(other) - 2 * ({lcs('name', 'other')}))::INTEGER AS distance FROM neighbours"),
    "token_set_ratio": with_(FACTS, NEIGHBOURS, "p AS (SELECT slug, name AS a, other AS b FROM neighbours)", set_ratio("p", "slug"), select="SELECT slug, round(score, 6) AS score FROM rated"),
    "dedup_check": with_(FACTS, "p AS (SELECT item_id AS new_id, slug, doc_id, text AS a, name AS b FROM benchmark CROSS JOIN facts WHERE type = 'mistake')", set_ratio("p", "new_id, slug, doc_id"), select="""SELECT new_id, CASE WHEN score >= 50 THEN slug END AS best_id,
  CASE WHEN score >= 50 THEN round(score, 6) END AS score, CASE WHEN score >= 80 THEN 'blocked' WHEN score >= 50 THEN 'candidate' ELSE 'allow' END AS decision FROM rated QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY score DESC, doc_id) = 1"""),
    "post_merge": with_(FACTS, MERGES, select="""SELECT m.project, m.slug, coalesce(m.recurrence + count(x.slug), -1)::BIGINT AS recurrence FROM mistakes m LEFT JOIN matches x ON x.score >= 80 AND x.to_project = m.project AND x.to_slug = m.slug
  WHERE NOT EXISTS (SELECT 1 FROM matches g WHERE g.score >= 80 AND g.project = m.project AND g.slug = m.slug) GROUP BY m.project, m.slug, m.recurrence"""),
    "merge_events": with_(FACTS, MERGES, select=f"""SELECT '{TODAY}' AS date, CASE WHEN score >= 80 THEN 'dedup-merged' ELSE 'dedup-candidate' END AS event,
  regexp_replace(slug, '\\.md$', '') || CASE WHEN score >= 80 THEN '>' ELSE '~' END || regexp_replace(to_slug, '\\.md$', '') AS target, 'm1' AS session FROM matches"""),
    "wal_scan": with_(wal(), select="SELECT line_no, date, event, target, session FROM wal"),
    "wal_validate": with_(wal(True), select="""SELECT CASE WHEN len(string_split(v, '|')) <> 4 THEN 'columns' WHEN NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN 'date' WHEN NOT regexp_full_match(event, '[a-z][a-z0-9-]*') THEN 'event' WHEN session = '' THEN 'session' ELSE 'ok' END AS reason, count(*) AS n
FROM (SELECT *, concat_ws('|', date, event, target, session) AS v FROM wal) GROUP BY 1"""),
    "wal_keyed": with_(wal(), keyed(), select="SELECT line_no, event, project, slug, key FROM keyed"),
    "content_sha": with_(FACTS, select="SELECT slug, content_sha FROM facts"),
    "scope_union": with_(FACTS, select=f"SELECT slug, project FROM facts WHERE project = '{PROJECT}' UNION ALL SELECT slug, 'global' FROM facts WHERE project = 'src0'"),
    "transcript_text": with_(JSONL, TEXTS, select="SELECT session, text FROM texts"),
    "transcript_metrics": with_(JSONL, METRICS, select="SELECT * FROM metrics"),
    "append_dedup": with_(wal(), select="SELECT DISTINCT date, event, target, session FROM wal WHERE line_no % 2 = 0 EXCEPT SELECT date, event, target, session FROM wal WHERE line_no % 2 = 1"),
    "session_set_union": with_(wal(), select="""SELECT session, array_to_string(list_sort(list(DISTINCT target)), ',') AS slugs FROM wal WHERE event IN ('inject', 'recall') GROUP BY session"""),
    "domain_filter": with_(ALL, select="SELECT slug, project FROM proj WHERE len(domains) = 0 OR list_has_any(domains, ['en', 'fr'])"),
    "scope_filter": with_(ALL, select=f"SELECT slug, project FROM proj WHERE project IN ('{PROJECT}', 'global')"),
    "recall_topk": with_(RANKED, STALE, ranked("aged", "recalled"), select="""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS rank, slug, project, overlap, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, project) AS rank FROM (SELECT * REPLACE (round(score, 6) AS score) FROM recalled WHERE overlap > 0)) q
  WHERE rank <= 12 AND CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 6 <> 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8"""),
    "skill_topk": with_(ALL, select=f"""SELECT skill, rank, slug, round(score, 6) AS score FROM (SELECT f.skill, p.slug, {STATIC.replace('project =', 'p.project =').replace('created ', 'p.created ')} AS score, row_number() OVER (PARTITION BY f.skill ORDER BY {STATIC.replace('project =', 'p.project =').replace('created ', 'p.created ')} DESC, p.slug, p.project) AS rank FROM proj p JOIN (SELECT slug, project, skill FROM facts WHERE type = 'skill-learning') f ON p.slug = f.slug AND p.project = f.project) WHERE rank <= 5"""),
    "wal_errors_7d": with_(wal(), select=f"SELECT event, count(*) AS n FROM wal WHERE event IN {_in(ERROR_EVENTS)} AND date >= strftime({_T} - 7, '%Y-%m-%d') GROUP BY event"),
    "open_quanta_30d": with_(wal(), QUANTA, select="SELECT *, CASE WHEN sessions > 0 AND open / sessions >= 0.5 THEN 'WARN' ELSE 'OK' END AS status FROM quanta"),
    "tombstones": with_(FACTS, REQUESTS, TERMS, select=f"SELECT DISTINCT query_id, slug, project FROM terms JOIN (SELECT slug, project, unnest({tokens(_FULL.replace(', body', ''))}) AS term FROM facts) USING (term)"),
    "prune_plan": with_(wal(), FACTS, select=f"""SELECT slug, project, status <> 'pinned' AND doc_id % 3 = 0 AND ((2024 - CAST(substr(created, 1, 4) AS INT)) * 365 + (1 - CAST(substr(created, 6, 2) AS INT)) * 30 + 31 - CAST(substr(created, 9, 2) AS INT)) > 30
  AND bare NOT IN (SELECT regexp_replace(target, '\\.md$', '') FROM wal WHERE event IN {_in(ACTIVE_EVENTS)} AND target IS NOT NULL) AS pruned FROM facts"""),
    "empty_status": with_(FACTS, select="SELECT slug, project FROM facts WHERE doc_id % 17 = 3"),
    "reproject": with_(ALL, select="SELECT slug, content_sha, type, name, project, created, last_injected, ref_count, status, round(effectiveness, 6) AS effectiveness, holdout_remaining FROM proj"),
    "graduation": with_(ALL, select="SELECT project, slug, graduated FROM hist"),
    "candidate_check": with_(wal(), QUIET, keyed().replace("FROM wal)", "FROM quiet)"), FACTS, CANDIDATES, select="SELECT * FROM flagged"),
    "overlap": with_(FACTS, REQUESTS, TERMS, KEYWORD, OVERLAP, select="SELECT query_id, slug, overlap FROM over"),
    "keyword_tf": with_(FACTS, KEYWORD, select="SELECT slug, project, term, weight FROM keyword"),
    "rank_topk": with_(RANKED, select="SELECT query_id, rank, slug, project, overlap, round(score, 6) AS score FROM ranked WHERE rank <= 8"),
    "score": with_(RANKED, select="SELECT query_id, slug, project, overlap, round(score, 6) AS score FROM scored"),
    "recency": with_(ALL, select=f"SELECT slug, project, round({recency('last_injected', 'created', _T)}, 6) AS recency FROM proj"),
    "effectiveness": with_(ALL, select="SELECT slug, project, round(effectiveness, 6) AS effectiveness FROM proj"),
    "inject_topk": with_(RANKED, select="""SELECT query_id, slug, project, CASE WHEN held THEN 'skipped' WHEN CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 7 = 2 THEN 'repeated' ELSE 'delivered' END AS outcome
FROM (SELECT *, CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 5 = 1 AS held, count(*) FILTER (WHERE CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 5 <> 1) OVER (PARTITION BY query_id ORDER BY rank) AS fresh FROM ranked) WHERE CASE WHEN held THEN fresh < 8 ELSE fresh <= 8 END"""),
    "degraded_rank": with_(FACTS, REQUESTS, TERMS, select=f"""SELECT query_id, rank, slug, project, overlap, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug, project) AS rank FROM (
  SELECT r.query_id, s.slug, s.project, count(*) AS overlap, 3 * count(*) + (1.0 + any_value({_BONUS})) AS score FROM terms JOIN requests r USING (query_id)
  JOIN (SELECT slug, CASE WHEN project = 'src0' THEN 'global' ELSE project END AS project, unnest(list_distinct({tokens(_FULL)})) AS term FROM facts) s ON s.term = terms.term AND s.project IN (r.own, 'global')
  GROUP BY r.query_id, s.slug, s.project)) WHERE rank <= 8"""),
    "holdout_clean": with_(wal(), keyed(), select="SELECT DISTINCT slug, session FROM keyed WHERE event = 'holdout-skip' EXCEPT SELECT slug, session FROM keyed WHERE event = 'inject'"),
    "wal_agg": with_(wal(), keyed(), AGG, select="SELECT * FROM agg"),
    "session_verdicts": with_(wal(), keyed(), VERDICTS, select="SELECT key, session, useful FROM verdicts"),
    "lifecycle_status": with_(wal(), keyed(), select="SELECT key, arg_max(event, line_no) = 'retire' AS retired FROM keyed WHERE event IN ('retire', 'revive') GROUP BY key"),
    "holdout_remaining": with_(wal(), keyed(), HOLD, select="SELECT h.key, CASE WHEN stopped THEN 0 ELSE greatest(n - (SELECT count(*) FROM skips s WHERE s.key = h.key), 0) END::BIGINT AS remaining FROM hold h"),
    "mark_stale": with_(ALL, STALE, select="SELECT slug, project, status FROM aged"),
    "reconcile": with_(ALL, select=f"""SELECT project, slug, status FROM (
SELECT coalesce(l.project, s.project, r.project) AS project, coalesce(l.slug, s.slug, r.slug) AS slug,
  CASE WHEN l.slug IS NOT NULL THEN l.status WHEN i.project IS NOT NULL AND r.slug IS NOT NULL THEN 'retired' WHEN i.project IS NULL THEN s.status WHEN b.key IS NOT NULL THEN 'retired' ELSE 'deleted' END AS status
FROM (SELECT project, slug, status FROM proj WHERE CAST(regexp_extract(slug, '\\d+') AS BIGINT) % 3 <> 0) l
FULL JOIN (SELECT project, slug, status FROM proj) s ON l.project = s.project AND l.slug = s.slug
FULL JOIN (SELECT DISTINCT k.project, k.slug || '.md' AS slug FROM keyed k JOIN agg a ON a.key = k.key AND a.retired WHERE k.project IS NOT NULL) r ON r.project = coalesce(l.project, s.project) AND r.slug = coalesce(l.slug, s.slug)
LEFT JOIN (SELECT DISTINCT source AS project FROM documents WHERE doc_id % 3 <> 0) i ON i.project = coalesce(l.project, s.project, r.project)
LEFT JOIN (SELECT key FROM agg WHERE retired AND NOT contains(key, chr(31))) b ON b.key || '.md' = coalesce(l.slug, s.slug, r.slug)) WHERE status IS NOT NULL"""),
    "session_metrics": with_(wal(), METRIC_ROWS, select="SELECT * FROM mrows"),
    "calibration": with_(wal(), METRIC_ROWS, select="""SELECT domain, count(*) AS sessions, sum(error_count)::BIGINT AS errors, round(sum(error_count) / count(*), 6) AS rate FROM (SELECT unnest(string_split(domains, ',')) AS domain, error_count FROM mrows) WHERE domain NOT IN ('', 'unknown') GROUP BY domain ORDER BY sum(error_count) / count(*) DESC, domain LIMIT 5"""),
    "profile_signals": with_(wal(), FACTS, f"""amb AS (SELECT DISTINCT bare FROM facts WHERE precision_class = 'ambient'),
posi AS (SELECT DISTINCT regexp_replace(target, '\\.md$', '') AS bare, session FROM wal WHERE event = 'outcome-positive'),
trg AS (SELECT regexp_replace(target, '\\.md$', '') AS bare, session, bool_or(event = 'trigger-useful') AS useful, bool_or(event = 'trigger-useful' AND date >= strftime({_T} - 30, '%Y-%m-%d')) AS ur, bool_or(event = 'trigger-silent' AND date >= strftime({_T} - 30, '%Y-%m-%d')) AS sr FROM wal WHERE event IN ('trigger-useful', 'trigger-silent') GROUP BY ALL),
tt AS (SELECT t.*, a.bare IS NOT NULL AS ambient, p.bare IS NOT NULL AS applied FROM trg t LEFT JOIN amb a ON a.bare = t.bare LEFT JOIN posi p ON p.bare = t.bare AND p.session = t.session),
s AS (SELECT count(*) FILTER (WHERE ambient) AS ambient, count(*) FILTER (WHERE NOT ambient AND useful) AS useful, count(*) FILTER (WHERE NOT ambient AND NOT useful) AS silent, count(*) FILTER (WHERE NOT ambient AND NOT useful AND applied) AS silent_applied,
  count(*) FILTER (WHERE NOT ambient AND useful AND ur) AS a, count(*) FILTER (WHERE NOT ambient AND NOT useful AND applied AND sr) AS b FROM tt),
c AS (SELECT count(DISTINCT session) FILTER (WHERE event = 'session-metrics') AS sessions, count(*) FILTER (WHERE event = 'clean-session') AS clean, count(*) FILTER (WHERE event = 'outcome-positive') AS positive, count(*) FILTER (WHERE event = 'outcome-negative') AS negative,
  count(*) FILTER (WHERE event = 'strategy-used') AS strategy_used, count(*) FILTER (WHERE event = 'strategy-gap') AS strategy_gap, count(*) FILTER (WHERE event = 'outcome-new') AS outcome_new, count(DISTINCT target) FILTER (WHERE event = 'evidence-empty') AS evidence_empty FROM wal)""",
        select="""SELECT sessions, clean, positive, negative, strategy_used, strategy_gap, outcome_new, evidence_empty, ambient, useful, silent, silent_applied, silent - silent_applied AS silent_noise,
  CASE WHEN useful + silent > 0 THEN round_even((useful + silent_applied) * 100.0 / (useful + silent), 0) END::DOUBLE AS precision_pct, CASE WHEN a > 0 THEN round(b / a, 6) END::DOUBLE AS intuition,
  CASE WHEN a = 0 THEN 'n/a' WHEN b / a >= 1 THEN 'high' WHEN b / a >= 0.6 THEN 'good' WHEN b / a >= 0.2 THEN 'some' ELSE 'low' END AS intuition_band FROM c, s"""),
    "profile_fractions": with_(wal(), FACTS, select=f"""SELECT round(count(*) FILTER (WHERE precision_class = 'ambient') / count(*), 6) AS ambient_fraction, round(count(*) FILTER (WHERE n IS NOT NULL) / count(*), 6) AS bayesian_fraction
FROM facts LEFT JOIN (SELECT target AS bare, count(*) AS n FROM wal WHERE event IN ('outcome-positive', 'outcome-negative') AND date >= strftime({_T} - 14, '%Y-%m-%d') GROUP BY target HAVING count(*) >= 5) USING (bare)"""),
    "weaknesses": with_(FACTS, select="SELECT slug, project, recurrence FROM facts WHERE type = 'mistake' AND recurrence > 0 ORDER BY recurrence DESC, slug LIMIT 5"),
    "strengths": with_(FACTS, select="SELECT slug, project, success_count FROM facts WHERE type = 'strategy' ORDER BY success_count DESC, slug LIMIT 5"),
    "corpus_counts": with_(ALL, STALE, select="SELECT f.type, count(*) AS n, count(*) FILTER (WHERE a.status = 'pinned') AS pinned, count(*) FILTER (WHERE a.status = 'stale') AS stale FROM facts f LEFT JOIN aged a USING (slug) GROUP BY f.type"),
    "doctor": with_(wal(), keyed(), FACTS, CANDIDATES, QUANTA, select=f"""SELECT 'corpus' AS name, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'WARN' END AS status, count(*) AS n FROM facts
UNION ALL SELECT 'wal_errors_7d', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END, count(*) FROM wal WHERE event IN {_in(ERROR_EVENTS)} AND date >= strftime({_T} - 7, '%Y-%m-%d')
UNION ALL SELECT 'open_quanta_last_30d', CASE WHEN sessions > 0 AND open / sessions >= 0.5 THEN 'WARN' ELSE 'OK' END, open FROM quanta
UNION ALL SELECT 'candidate_corroboration', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END, count(*) FROM flagged
UNION ALL SELECT 'frontmatter_quality', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END, count(*) FROM facts WHERE doc_id % 17 = 3"""),
    "useful_streak": with_(wal(), TRIM, STREAK, select="SELECT * FROM streak"),
    "ablate_report": with_(wal(), TRIM, RUNS0.format(k="slug"), select="""SELECT g AS slug, coalesce(stopped, 'running') AS state, requested, observed, hits, CASE WHEN observed > 0 THEN round(hits / observed, 6) END::DOUBLE AS rate,
CASE WHEN observed = 0 THEN 'no observations' WHEN hits / observed >= 0.75 THEN 'internalized' WHEN hits / observed <= 0.25 THEN 'keep' ELSE 'inconclusive' END AS verdict FROM runs"""),
    "promote": with_(wal(), FACTS, TRIM, RUNS0.format(k="key"), STREAK, """hp AS (SELECT k.key, k.c, coalesce(v.u, 0) AS u, coalesce(v.s, 0) AS s, st.streak, r.requested, r.stopped, r.observed, r.hits FROM (SELECT key, bool_or(event = 'candidate-confirmed') AS c FROM kt GROUP BY key) k
  LEFT JOIN (SELECT key, count(*) FILTER (WHERE useful) AS u, count(*) FILTER (WHERE NOT useful) AS s FROM vt GROUP BY key) v ON v.key = k.key LEFT JOIN streak st ON st.key = k.key LEFT JOIN runs r ON r.g = k.key),
pr AS (SELECT f.bare AS slug, f.project, f.type, f.recurrence, f.status, h.* FROM facts f LEFT JOIN hp h ON h.key = CASE WHEN EXISTS (SELECT 1 FROM hp x WHERE x.key = f.project || chr(31) || f.bare) THEN f.project || chr(31) || f.bare ELSE f.bare END),
pj AS (SELECT slug, project, CASE WHEN type = 'mistake' AND recurrence >= 2 THEN 'recurrence' WHEN streak THEN 'streak' WHEN requested > 0 AND (stopped IS NOT NULL OR observed >= requested) AND observed > 0 AND hits / observed >= 0.75 THEN 'internalized'
  WHEN status = 'candidate' AND NOT coalesce(c, false) AND coalesce(u, 0) = 0 AND coalesce(s, 0) >= 5 THEN 'never-corroborated' END AS reason FROM pr)""",
        select="SELECT slug, project, CASE reason WHEN 'recurrence' THEN 'mechanical' WHEN 'streak' THEN 'claudemd' ELSE 'retire' END AS kind, reason FROM pj WHERE reason IS NOT NULL"),
    "ab_pool": with_(wal(), select="SELECT DISTINCT target AS slug FROM wal"),
    "ab_eval_sessions": with_(wal(), EVAL, select="SELECT session, date, array_to_string(useful, ',') AS useful FROM ses"),
    "ab_signals": with_(wal(), EVAL, SIGNALS, select="SELECT * FROM sig"),
    "ab_replay": with_(wal(), EVAL, SIGNALS, f"""cand AS (SELECT d.date, p.slug, coalesce(ref_count, 0) AS rc, (coalesce(pos, 0) + 1) / (coalesce(pos, 0) + coalesce(neg, 0) + 2) AS eff, last_inject AS li FROM (SELECT DISTINCT date FROM ses) d CROSS JOIN (SELECT DISTINCT target AS slug FROM wal) p LEFT JOIN sig USING (date, slug)),
rk AS (SELECT date, slug, row_number() OVER (PARTITION BY date ORDER BY log10(1 + rc) * least(greatest(2 * eff, 0), 1) + 2 * {recency('li', "''", 'CAST(date AS DATE)')} + 2 * eff DESC, slug) AS rank FROM cand),
us AS (SELECT session, date, len(useful) AS size, unnest(useful) AS slug FROM ses)""",
        select="SELECT k, count(*) AS sessions, round(avg(h / size), 6) AS recall FROM (SELECT ks.k, session, size, count(*) FILTER (WHERE rank <= ks.k) AS h FROM us LEFT JOIN rk USING (date, slug) CROSS JOIN (SELECT unnest([3, 5, 8, 12])::INTEGER AS k) ks GROUP BY ks.k, session, size) GROUP BY k"),
    "wal_active": with_(wal(), select=f"SELECT DISTINCT regexp_replace(target, '\\.md$', '') AS slug FROM wal WHERE event IN {_in(ACTIVE_EVENTS)}"),
    "classify": with_(FACTS, JSONL, TEXTS, DELIVERED, CLASSIFY, select="SELECT session, slug, useful FROM classified"),
    "close_events": with_(FACTS, JSONL, TEXTS, METRICS, DELIVERED, CLASSIFY, select=f"""SELECT '{TODAY}' AS date, CASE WHEN useful THEN 'trigger-useful' ELSE 'trigger-silent' END AS event, slug AS target, session FROM classified
UNION ALL SELECT '{TODAY}', 'candidate-confirmed', slug, min(session) FROM classified WHERE useful AND slug IN (SELECT slug FROM facts WHERE status = 'candidate') GROUP BY slug
UNION ALL SELECT '{TODAY}', 'session-metrics', 'domains:,error_count:' || errors || ',tool_calls:' || tool_calls || ',duration:' || seconds || 's', session FROM metrics
UNION ALL SELECT '{TODAY}', 'session-close', session, session FROM metrics"""),
    "memindex_render": with_(FACTS, "ln AS (SELECT project, slug, '- [' || CASE WHEN name = '' THEN bare ELSE name END || '](' || slug || ') — ' || CASE WHEN length(description) <= 120 THEN description ELSE rtrim(substr(description, 1, 120), ' ') || '…' END || chr(10) AS line FROM facts)",
        select="SELECT * FROM (SELECT project, slug, line, (15 + sum(strlen(line)) OVER (PARTITION BY project ORDER BY slug))::BIGINT AS bytes_so_far FROM ln) WHERE bytes_so_far <= 24000"),
    "migrate_route": with_(FACTS, select="SELECT slug, project, CASE WHEN CAST(substr(project, 4) AS INT) % 2 = 0 THEN 'projects/-home-u-' || project || '/memory' ELSE 'global' END AS target_dir FROM facts"),
    "migrate_slugs": with_(FACTS, select="SELECT type AS dir, project AS sub, doc_id AS walk, CASE WHEN row_number() OVER (PARTITION BY type, skill || (doc_id % 40) ORDER BY doc_id) > 1 THEN project || '-' ELSE '' END || skill || (doc_id % 40) AS slug FROM facts"),
    "migrate_native": with_(FACTS, select="""SELECT slug, '---' || chr(10) || 'name: "' || replace(CASE WHEN doc_id % 2 = 0 THEN name ELSE upper(substr(bare, 1, 1)) || substr(bare, 2) END, '"', '''') || '"' || chr(10) || 'description: "' || replace(CASE WHEN description <> '' THEN description ELSE coalesce(substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> '')[1], 1, 100), '') END, '"', '''') || '"' || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10)
|| regexp_replace(CASE WHEN doc_id % 4 = 0 THEN '**Root cause:** cause ' || doc_id || chr(10) || chr(10) ELSE '' END || body, '^\\s+|\\s+$', '', 'g') || chr(10) AS content FROM facts"""),
    "tokenize": with_(FACTS, select=f"SELECT slug, array_to_string({tokens('body')}, ' ') AS tokens FROM facts"),
    "query_terms": with_(REQUESTS, TERMS, select="SELECT query_id, term FROM terms"),
    "default_process": with_(FACTS, select="SELECT slug, trim(regexp_replace(lower(body), '[^\\p{L}\\p{Nd}_]', ' ', 'g')) AS processed FROM facts"),
    "truncate_desc": with_(FACTS, select="SELECT slug, CASE WHEN length(description) <= 120 THEN description ELSE rtrim(substr(description, 1, 120), ' ') || '…' END AS description FROM facts"),
    "secrets_scan": "SELECT doc_id, regexp_matches(t, '" + SECRET_KEY.replace("'", "''") + "') AS by_key, " + " + ".join(f"regexp_matches(t, '{p}')::INT" for p in SECRET_VALUES) + " AS by_value FROM (SELECT doc_id, regexp_replace(text, '`[^`\\n]*`', '', 'g') AS t FROM documents)",
}
