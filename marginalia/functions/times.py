"""Instants, ages and their display. Nothing here reads the clock: "now" is always given."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_time(text: str, now: datetime) -> datetime:
    """An age (30m, 24h, 7d, 2w) before ``now``, a civil date (midnight UTC) or a full timestamp."""
    text = text.strip()
    if m := re.fullmatch(r"([0-9]+)([mhdw])", text):
        try:
            return now - timedelta(**{_UNITS[m[2]]: int(m[1])})
        except OverflowError:
            raise ValueError(f"too long ago: {text}") from None
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return datetime.fromisoformat(text).replace(tzinfo=UTC)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"no time: {text}") from None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def humanize_age(seconds: Column) -> Column:
    """The largest whole unit: seconds, minutes, hours, days or weeks."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    whole = lambda size: F.floor(s / size).cast("long").cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"))).when(s < 86400, F.concat(whole(3600), F.lit("h")))
        .when(s < 14 * 86400, F.concat(whole(86400), F.lit("d"))).otherwise(F.concat(whole(7 * 86400), F.lit("w")))
    )


def start_of_day(at: Column) -> Column:
    return F.date_trunc("day", at)


def authored(author: Column, committer: Column, now: Column) -> Column:
    """A commit's time: the earlier of author and committer, never in the future."""
    return F.least(author, committer, now)
