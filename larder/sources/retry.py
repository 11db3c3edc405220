"""Calls to databases and stores that are repeated while their failure is transient."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from ..functions import predicates as P

T = TypeVar("T")


def call(action: Callable[[], T], transient: Callable[[Exception], bool] | None = None, attempts: int = 3, base: float = 2.0, cap: float = 60.0, jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> T:
    """The action's result. A transient failure is tried again after base^n seconds (at most ``cap``, give or take the jitter's share), any other is raised at once."""
    judge = transient or (lambda e: any(w in str(e).lower() for w in P.RETRYABLE_WORDS))
    for n in range(1, max(attempts, 1) + 1):
        try:
            return action()
        except Exception as e:
            if n >= max(attempts, 1) or not judge(e):
                raise
            sleep(min(base**n, cap) * (1 + random.uniform(-jitter, jitter)))
    raise AssertionError("unreachable")
