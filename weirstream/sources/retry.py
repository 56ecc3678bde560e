"""The retry policy that sinks share."""

from __future__ import annotations

import time
from collections.abc import Callable


def with_retries(task: Callable[[], object], retries: int, interval_s: float, between: Callable[[], None] | None = None):
    """Run a task once and up to `retries` times more, sleeping in between; the last error is chained."""
    last: Exception | None = None
    for attempt in range(retries + 1):
        try:
            return task()
        except Exception as e:  # noqa: BLE001  any failure is tried again
            last = e
            if attempt < retries:
                time.sleep(interval_s)
                if between:
                    between()
    raise RuntimeError(f"failed after {retries} retries") from last
