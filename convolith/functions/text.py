"""Column builders on text: matching, tokens, previews, dates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's edges: what is neither alphabetic nor a number.
_EDGE = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def contains_text(content: Column, query: str) -> Column:
    """Literal, case-insensitive substring; the empty query is everywhere, null content nowhere."""
    return F.contains(F.lower(content), F.lit(query.lower()))


def tokens(content: Column) -> Column:
    """Distinct lower-cased words, cut at Unicode white space, trimmed of other signs at their edges."""
    words = F.split(F.lower(content), r"(?U)\s+")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != ""))


def query_tokens(query: str) -> list[str]:
    """The same words of a query, on the driver."""
    out = []
    for w in query.lower().split():
        while w and not (w[0].isalpha() or w[0].isnumeric()):
            w = w[1:]
        while w and not (w[-1].isalpha() or w[-1].isnumeric()):
            w = w[:-1]
        if w and w not in out:
            out.append(w)
    return out


def since(created_at: Column, after: int | None) -> Column:
    """Not before ``after``; undated rows always pass."""
    return F.lit(True) if after is None else created_at.isNull() | (created_at >= F.lit(after).cast("decimal(20,0)"))


def until(created_at: Column, before: int | None) -> Column:
    """Not after ``before``; undated rows always pass."""
    return F.lit(True) if before is None else created_at.isNull() | (created_at <= F.lit(before).cast("decimal(20,0)"))


def is_blank(content: Column) -> Column:
    """Nothing but Unicode white space."""
    return F.regexp_replace(content, r"(?U)\s+", "") == ""


def preview(content: Column, size: int = 60) -> Column:
    """The first characters, with dots where the text takes more than ``size`` bytes."""
    return F.when(F.octet_length(content) > size, F.concat(F.left(content, F.lit(size)), F.lit("..."))).otherwise(content)


def display_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("Untitled"))


def normal_role(role: Column) -> Column:
    """The stored role; null where the name is unknown."""
    return F.when(role == "assistant", "model").when(role.isin("user", "system", "model", "thought", "tool"), role)


def export_role(role: Column) -> Column:
    """The role of a tree export's author; unknown ones speak as the user."""
    return F.when(role == "assistant", "model").when(role.isin("system", "tool"), role).otherwise("user")


def format_seconds(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss 'UTC'")


def megabytes(size: Column) -> Column:
    return F.format_string("%.2f", size / F.lit(1024.0 * 1024.0))


def seconds_of(text: Column) -> Column:
    """Digits are unix seconds, a date is its midnight UTC (before 1970: 0), anything else null."""
    number = F.when(text.rlike(r"^\+?\d{1,20}$"), F.regexp_replace(text, r"^\+", "").cast("decimal(20,0)"))
    date = F.when(text.rlike(r"^[+-]?\d{1,6}-\d{1,2}-\d{1,2}$"), F.unix_seconds(F.try_to_timestamp(text, F.lit("y-M-d"))))
    return F.coalesce(number, F.when(date < 0, F.lit(0)).otherwise(date).cast("decimal(20,0)"))


def parse_when(text: str) -> int:
    """The same on the driver; raises ValueError for anything else."""
    digits = text.removeprefix("+")
    if digits.isascii() and digits.isdigit() and int(digits) < 1 << 64:
        return int(digits)
    try:
        return max(0, int(datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp()))
    except ValueError:
        raise ValueError(f"'{text}' is neither unix seconds nor a date like 2024-01-31") from None
