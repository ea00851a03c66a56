"""Policy of page collection: what may be fetched and when a request is tried again. No network code."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

RETRIED = frozenset((429, 500, 502, 503, 504))


class AccessError(Exception):
    """A page that may not be fetched."""


class AuthorizationRequired(AccessError):
    """A recipe page without the explicit permission to fetch recipe pages."""


class RobotsBlocked(AccessError):
    """A page the site's robots rules exclude."""


def check_access(url: str, *, allow_recipes: bool = False, override: bool = False, disallowed: Iterable[str] = ()) -> None:
    """Raises unless the page may be fetched. ``override`` of the robots rules needs ``allow_recipes``."""
    if override and not allow_recipes:
        raise ValueError("override needs allow_recipes")
    path = urlsplit(url).path
    if path.startswith("/receita/") and not allow_recipes:
        raise AuthorizationRequired(url)
    if not override and any(path.startswith(p) for p in disallowed if p):
        raise RobotsBlocked(url)


def retry_delay(attempt: int, status: int | None, retry_after: str | None = None, *, retries: int = 3, now: datetime | None = None) -> float | None:
    """Seconds to wait before the next try, None for no further try; ``status`` None is a network error."""
    if attempt >= retries or (status is not None and status not in RETRIED):
        return None
    if status is None:
        return float(2**attempt)
    if retry_after:
        if retry_after.strip().isdigit():
            return float(retry_after)
        try:
            when = parsedate_to_datetime(retry_after)
        except (TypeError, ValueError):
            when = None
        if when is not None:
            when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
            return max(0.0, (when - (now or datetime.now(timezone.utc))).total_seconds())
    return float(2 ** (attempt + 1))
