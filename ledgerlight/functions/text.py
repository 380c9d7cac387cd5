"""Text expressions; all are Spark built-ins and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DESCRIPTION_CHARS, MAX_BODY_BYTES, MIN_ROOT_CAUSE, STOPWORDS

WORD_CLASS = r"[\p{L}\p{Nd}_]"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased runs of three or more letters, digits or underscores, without stopwords; repeats stay, null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD_CLASS}{{3,}})"), F.lit(1))
    listed = list(dict.fromkeys(stopwords))
    return F.filter(found, lambda w: ~w.isin(listed))


def query_terms(*parts: Column) -> Column:
    """Distinct tokens of several texts, in order of first appearance."""
    return F.array_distinct(F.flatten(F.array(*[tokenize(p) for p in parts])))


def default_process(text: Column) -> Column:
    """Lower case, each character that is no letter, digit or underscore a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}_]", " "))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_list(value: Column) -> Column:
    """Items of ``[a, "b"]``, ``a, b`` or a scalar: trimmed, then unquoted, empties dropped."""
    inner = F.regexp_replace(strip(value), r"^\[|\]$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), r"""^["']+|["']+$""", ""))
    return F.filter(items, lambda x: x != "")


def cap_body(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    """At most ``limit`` bytes, cut before a character that would be split, with a mark; short bodies as they are."""
    raw = body.cast("binary")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, limit - k)) for k in range(4)])
    return F.when(F.octet_length(body) <= limit, body).otherwise(F.concat(F.regexp_replace(cut, r"[ \n]+$", ""), F.lit("\n\n…(truncated)")))


def truncate(text: Column, chars: int = DESCRIPTION_CHARS) -> Column:
    """At most ``chars`` characters, trailing spaces trimmed, with an ellipsis if cut."""
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, chars)), F.lit("…")))


def sanitize(text: Column) -> Column:
    """Column separators and line ends as underscores."""
    return F.translate(text, "|\n\r", "___")


def safe_name(text: Column) -> Column:
    """A file name of ``[A-Za-z0-9._-]``; empty becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), "^$", "_")


def bare_slug(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def root_cause(text: Column) -> Column:
    """The value of the first ``root-cause:`` line, unquoted; null under ten characters, as for the mark of a block."""
    value = strip(F.regexp_extract(text, r"""(?md)^root-cause:\s*["']?(.+?)["']?\s*$""", 1))
    return F.when(F.char_length(value) >= MIN_ROOT_CAUSE, value)


#: Patterns of credentials, reconstructed from the documented behaviour: by key, then by value.
SECRET_KEY = r"(?i)[A-Za-z0-9_-]*(?:api_?key|secret|password|passphrase|token)[A-Za-z0-9_-]*\s*[:=]\s*\S{8,}"
SECRET_VALUES = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"xox[bpars]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@",
)
FENCE = r"(?ms)^(```|~~~)([^\n]*)\n.*?^\1[ \t]*$"


#: Strings, in lower case, of which every match of the key pattern holds one, and for each value pattern strings of which every match holds one.
KEY_HINTS = ("key", "secret", "password", "passphrase", "token")
VALUE_HINTS = (("AKIA", "ASIA"), tuple(f"gh{c}_" for c in "pousr"), ("github_pat_",), ("sk-ant-",), ("xox",), ("-----BEGIN ",), ("eyJ",), ("://",))


def _holds(text: Column, hints: tuple[str, ...]) -> Column:
    out = text.contains(hints[0])
    for h in hints[1:]:
        out = out | text.contains(h)
    return out


def without_code(text: Column) -> Column:
    """The text without bodies of closed fences and inline code; what follows a fence's marks on its line stays."""
    cut = F.regexp_replace(F.regexp_replace(text, FENCE, "$2"), r"`[^`\n]*`", "")
    return F.when(_holds(text, ("`", "~~~")), cut).otherwise(text)


def secret_hits(text: Column) -> Column:
    """Whether the key pattern, and how many of the value patterns, occur outside code.

    A pattern is tried only on texts that hold a string it can't match without; the key pattern's
    leading characters may be none, so they don't matter to whether it occurs.
    """
    key = SECRET_KEY.replace("[A-Za-z0-9_-]*", "", 1)

    def hits(body: Column) -> Column:
        by_key = F.when(_holds(F.lower(body), KEY_HINTS), body.rlike(key)).otherwise(False)
        values = sum((F.when(_holds(body, h), body.rlike(p).cast("int")).otherwise(0) for p, h in zip(SECRET_VALUES, VALUE_HINTS)), F.lit(0))
        return F.struct(by_key.alias("by_key"), values.alias("by_value"))

    found = let(without_code(text), hits)
    # A null text has null hits, as a pattern has on it.
    return F.when(text.isNotNull(), found).otherwise(F.struct(F.lit(None).cast("boolean").alias("by_key"), F.lit(None).cast("int").alias("by_value")))
