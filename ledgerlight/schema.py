"""Weights, thresholds, vocabularies and row types of the engine, as data."""

from __future__ import annotations

from pyspark.sql import types as T

#: Weights of the additive score, limits and thresholds.
W_OVERLAP, W_USE, W_RECENCY, W_EFFECT, W_PROJECT = 3.0, 1.0, 2.0, 2.0, 1.0
RECENCY_DAYS = 30.0
TOP_K, SKILL_K, RECALL_SPARE = 8, 5, 4
MAX_BODY_BYTES, MAX_TOTAL_BYTES, INDEX_BYTES, DESCRIPTION_CHARS = 2500, 8000, 24_000, 120
DEFAULT_HOLDOUT = 5
BLOCK_AT, CANDIDATE_AT, MIN_ROOT_CAUSE = 80.0, 50.0, 10
MIN_RECURRENCE, STREAK, HIT_RATE, LOW_RATE, SILENT_LIMIT = 2, 5, 0.75, 0.25, 5
OPEN_WARN = 0.5
OUTCOME_DAYS, INTUITION_DAYS = 14, 30
SEPARATOR = "\x1f"
#: Project name of the store that all projects share.
GLOBAL = "global"
TAIL_BYTES = 256 * 1024
MAX_LINE_BYTES, MAX_TRANSCRIPT_LINE = 1 << 20, 4 << 20

#: Days after which an active fact of a type is stale; other types take 90; continuity and project never are.
DECAY_DAYS = {"mistake": 60, "strategy": 90, "feedback": 45, "knowledge": 90, "decision": 90, "note": 30, "skill-learning": 120}
DECAY_DEFAULT, DECAY_EXEMPT = 90, ("continuity", "project")

#: Events that close a session, and events that count as errors of the log itself.
CLOSING_EVENTS = ("trigger-useful", "trigger-silent", "trigger-silent-retro", "outcome-positive", "outcome-negative", "clean-session")
ERROR_EVENTS = ("schema-error", "format-unsupported", "evidence-missing", "evidence-empty")
ACTIVE_EVENTS = ("inject", "inject-agg", "outcome-positive", "outcome-negative", "trigger-useful")

#: Fact types in the order of the format description.
FACT_TYPES = ("mistake", "strategy", "feedback", "knowledge", "decision", "note", "project", "continuity", "skill-learning")

LOG = T.StructType([T.StructField("line_no", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("date", "event", "target", "session")])
TRANSCRIPT_LINE = "type string, sessionId string, timestamp string, message struct<content: array<struct<type: string, text: string, is_error: boolean>>>"

#: Function words that carry no relevance (English, then Russian).
STOPWORDS = tuple(
    """
the and for are but not you all any can her was one our out has had have his him how its may new now old see two who did
does done this that these those then than with from into onto over under your they them their there here what when where
which while will would could should shall must might been being were such some each most more much many only also just very
too about above after again before because both between during other same use used using get got make made let
что как это этот эта эти того этого этой для когда если или был была было были быть есть надо может можно где уже только
чтобы чтоб потому поэтому так также тоже его они она оно все всё всех всем всего весь вся кто чем который которая которые
которых нет да без над под при про после перед через между даже ещё еще вот нас вас них нам вам им их ему ней нее неё том
тем тот той эту мой моя наш ваш свой своя себя себе более менее очень почти потом затем теперь здесь туда сюда тут там
будет будут нужно
""".split()
)
