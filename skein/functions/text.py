"""Scalar text functions as column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_CHARS, CHARS_PER_TOKEN = 400, 4


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and _ of at least two characters; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of which are dots when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.call_function("div", F.length(text), F.lit(CHARS_PER_TOKEN))).cast("bigint")


def bounded(text: Column, limit: int, marker: str = "\n[cut]") -> Column:
    """The first `limit` characters and a marker when there were more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def strip_command_markup(text: Column) -> Column:
    """Text without command-name and command-message elements, trimmed of white space."""
    out = F.regexp_replace(text, r"(?s)<command-name>.*?</command-name>", "")
    out = F.regexp_replace(out, r"(?s)<command-message>.*?</command-message>", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalized_title(text: Column, limit: int = 2000) -> Column:
    """A title on one line: markup tags, terminal colours and control characters out, white space collapsed."""
    out = F.substring(text, 1, limit)
    out = F.regexp_replace(out, r"(?s)<([a-zA-Z][\w-]*)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"</?[a-zA-Z][\w-]*\b[^>]*>", " ")
    out = F.regexp_replace(out, "\u001b\\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def path_tail(path: Column, parts: int = 2) -> Column:
    """The last parts of a path."""
    pieces = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.array_join(F.slice(pieces, F.greatest(F.size(pieces) - (parts - 1), F.lit(1)), F.lit(parts)), "/")


def at_or_beneath(child: Column, ancestor: Column) -> Column:
    """Whether a path is an ancestor or lies under it."""
    base = F.regexp_replace(ancestor, "/+$", "")
    return (child == base) | child.startswith(F.concat(base, F.lit("/")))


def content_id(text: Column, start: Column | None = None, length: int = 16) -> Column:
    """A short digest of a start position and a text."""
    at = F.lit(0) if start is None else start
    return F.substring(F.sha2(F.concat(at.cast("string"), F.lit(":"), text), 256), 1, length)


def canonical_digest(*names: str) -> Column:
    """Digest of the named columns as JSON with nulls kept and keys sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down, also below zero."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def ceil_div(a: Column, b: int) -> Column:
    return -floor_div(-a, b)


def reference(ref: Column) -> tuple[Column, Column]:
    """Session and episode number of a reference `session:ep:number`; nulls for text of any other form."""
    form = r"^(.+):ep:(\d+)$"
    return F.when(ref.rlike(form), F.regexp_extract(ref, form, 1)), F.when(ref.rlike(form), F.regexp_extract(ref, form, 2).try_cast("bigint"))


def epoch_to_millis(value: Column) -> Column:
    """Seconds or milliseconds since 1970 as milliseconds: 1e10 and more are milliseconds."""
    return F.when(F.abs(value) >= 10_000_000_000, value).otherwise(value * 1000)


def densest_start(text: Column, query: str, limit: int) -> Column:
    """The start (from 1) of the window of `limit` characters with most occurrences of the query's tokens (three characters and
    more): one window a token, a third before its first place, of equals the earliest; 1 when no token occurs."""
    tokens = list(dict.fromkeys(re.findall(r"[\w./:-]{3,}", query.strip().lower())))
    if not tokens:
        return F.lit(1)
    low = F.lower(text)
    starts = F.array_compact(F.array(*[F.when(F.instr(low, F.lit(t)) > 0, F.greatest(F.lit(1), F.instr(low, F.lit(t)) - limit // 3)) for t in tokens]))

    def hits(start: Column) -> Column:
        window = low.substr(start, F.lit(limit))
        left = [F.call_function("div", F.length(window) - F.length(F.replace(window, F.lit(t), F.lit(""))), F.lit(len(t))) for t in tokens]
        return sum(left[1:], left[0])

    best = F.array_max(F.transform(starts, lambda p: F.struct(hits(p).alias("n"), (-p).alias("at"))))
    return F.coalesce(-best["at"], F.lit(1))


def excerpt(text: Column, query: str, limit: int = EXCERPT_CHARS, snap: int = 40) -> Column:
    """A stretch of at most `limit` characters around the first occurrence of a phrase, without one the stretch with most
    of its words, its start moved to the next blank within `snap` characters, with dots where text was left out."""
    at = F.instr(F.lower(text), F.lit(query.lower()))
    centre = F.greatest(F.lit(1), at + len(query) // 2 - limit // 2)
    start = F.greatest(F.lit(1), F.least(F.when(at == 0, densest_start(text, query, limit)).otherwise(centre), F.length(text) - limit + 1))
    near = F.instr(text.substr(start, F.lit(snap)), " ")
    start = F.when((start > 1) & (near > 0), start + near).otherwise(start)
    body = text.substr(start, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(start > 1, "...").otherwise(""), F.btrim(body), F.when(start + limit <= F.length(text), "...").otherwise("")))
