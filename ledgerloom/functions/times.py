"""Relative times and bucket widths as users write them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_SINCE = {"h": 3600, "d": 86400, "w": 7 * 86400, "m": 30 * 86400}
_BUCKET = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}
MOST_BUCKETS = 10_000


def since(text: str, now: datetime) -> datetime:
    """``24h 7d 4w 2m`` (m: 30 days) before ``now``, or an ISO time with offset, in UTC."""
    if m := re.fullmatch(r"(\d+)([hdwm])", text.strip()):
        return now.astimezone(timezone.utc) - timedelta(seconds=int(m[1]) * _SINCE[m[2]])
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    if at.tzinfo is None:
        raise ValueError(f"a time needs an offset: {text!r}")
    return at.astimezone(timezone.utc)


def bucket_seconds(text: str) -> int:
    """``30s 5m 1h 1d 1w`` (m: minutes)."""
    m = re.fullmatch(r"(\d+)([smhdw])", text.strip())
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a bucket width: {text!r}")
    return int(m[1]) * _BUCKET[m[2]]


def retention(text: str | int) -> int | None:
    """Days to keep; ``forever`` or a negative number: always."""
    if str(text).strip().lower() == "forever":
        return None
    days = int(text)
    return None if days < 0 else days
