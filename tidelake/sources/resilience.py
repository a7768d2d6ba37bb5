"""Retrying what may fail for a while: full jitter between tries, and a breaker that stops asking what keeps failing."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class CircuitOpen(ConnectionError):
    """Not tried, as the last tries failed and the pause isn't over."""


class Breaker:
    """Opens after ``failures`` in a row, for ``pause_s``; then one try decides whether it closes or opens anew."""

    def __init__(self, failures: int = 5, pause_s: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.pause_s, self.clock = failures, pause_s, clock
        self.failed, self.until = 0, 0.0

    def before(self) -> None:
        if self.failed >= self.most and self.clock() < self.until:
            raise CircuitOpen(f"{self.failed} failures in a row, next try in {self.until - self.clock():.1f} s")

    def after(self, success: bool) -> None:
        self.failed = 0 if success else self.failed + 1
        if self.failed >= self.most:
            self.until = self.clock() + self.pause_s


def retried(
    call: Callable[[], object], tries: int = 5, base_s: float = 0.2, cap_s: float = 10.0, on: tuple[type[BaseException], ...] = (OSError,),
    breaker: Breaker | None = None, sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform,
):
    """The call's result. After failure n it waits from 0 up to base * 2^n seconds (at most ``cap_s``), drawn evenly; the last failure is raised."""
    for n in range(tries):
        try:
            if breaker:
                breaker.before()
            found = call()
        except on as e:
            if breaker and not isinstance(e, CircuitOpen):
                breaker.after(False)
            if n + 1 == tries:
                raise
            sleep(draw(0.0, min(cap_s, base_s * 2**n)))
        else:
            if breaker:
                breaker.after(True)
            return found
