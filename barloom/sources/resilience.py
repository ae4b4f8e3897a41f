"""Retries and a circuit breaker around a connector, on the driver."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class SymbolNotFound(Exception):
    """The provider doesn't know the symbol; asking again is no use."""


class ProviderUnavailable(Exception):
    """The breaker is open, or every attempt failed."""


class CircuitBreaker:
    """Opens after so many failures in a row; after a pause it lets calls through until one succeeds or fails."""

    def __init__(self, failures: int = 5, pause: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.pause, self.clock = failures, pause, clock
        self.state, self.failures, self.opened = "CLOSED", 0, 0.0

    def allows(self) -> bool:
        if self.state == "OPEN" and self.clock() > self.opened + self.pause:
            self.state = "HALF_OPEN"
        return self.state != "OPEN"

    def succeeded(self) -> None:
        self.state, self.failures = "CLOSED", 0

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= self.limit:
            self.state, self.opened = "OPEN", self.clock()


def with_retries(call: Callable, breaker: CircuitBreaker, attempts: int = 3, base: float = 1.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; waits ``base * 2**(n - 1)`` and some jitter between attempts.  The breaker is asked once, before the first."""
    if not breaker.allows():
        raise ProviderUnavailable("the circuit breaker is open")
    for n in range(1, attempts + 1):
        try:
            result = call()
        except SymbolNotFound:
            raise
        except Exception as e:
            breaker.failed()
            if n == attempts:
                raise ProviderUnavailable(f"{attempts} attempts failed") from e
            sleep(base * 2 ** (n - 1) + random.uniform(0, jitter))
        else:
            breaker.succeeded()
            return result


class LiveCallGuard:
    """Refuses live calls while a simulation runs."""

    def __init__(self, simulating: bool):
        self.simulating = simulating

    def __call__(self, call: Callable, *args):
        if self.simulating:
            raise PermissionError("a simulation makes no live calls")
        return call(*args)
