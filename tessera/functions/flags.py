"""Record flags and time to live."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stored flags by letter: read-only, append-only, protected, hidden, cached, volatile, user flags;
#: e (expiring), g (group) and l (link) are derived.
LETTERS = "raphcv0123egl"
TRANSIENT = "uwmny"
DAY = 1440


def mask(letters: str) -> int:
    """Bits of stored letters."""
    bits = 0
    for c in letters:
        if c in TRANSIENT:
            raise ValueError(f"{c!r} is not stored with records")
        bits |= 1 << LETTERS.index(c)
    return bits


def parse_flags(spec: str) -> tuple[int, int]:
    """``'+r-0'`` to (needed bits, denied bits); letters without a sign are needed."""
    need = deny = 0
    sign = "+"
    for c in spec:
        if c in "+-":
            sign = c
        elif sign == "+":
            need |= mask(c)
        else:
            deny |= mask(c)
    return need, deny


def flags_match(flags: Column, need: int, deny: int) -> Column:
    return (flags.bitwiseAND(need) == need) & (flags.bitwiseAND(deny) == 0)


def ttl_minutes(ttl: int | float | str | dt.timedelta | None) -> int:
    """Minutes of a time to live: whole days up to 511, else minutes up to 1439; 0 is for ever.

    A number is days; under a day it is rounded up to whole minutes, over a day to whole days.
    """
    if not ttl:
        return 0
    days = ttl / dt.timedelta(days=1) if isinstance(ttl, dt.timedelta) else float(ttl)
    if days <= 0:
        return 0
    if days < 1:
        return max(1, min(DAY - 1, round(days * DAY)))
    return min(511, round(days)) * DAY


def expired(ttl: Column, mdate: Column, mtime: Column | None, as_of: Any) -> Column:
    """Whether a record is past its time to live at ``as_of``; never where it has none."""
    now = F.lit(as_of)
    whole = ttl % DAY == 0
    by_day = F.to_date(now) > F.date_add(mdate, F.floor(ttl / DAY).cast("int"))
    if mtime is None:
        return F.coalesce((ttl > 0) & whole & by_day, F.lit(False))
    late = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 SECONDS") > mtime + F.make_dt_interval(mins=ttl)
    return F.coalesce((ttl > 0) & F.when(whole, by_day).otherwise(late), F.lit(False))
