"""The clock service: draws, persists, restores and advances; time is injected."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from mergelake.functions.hlc import COUNTER_BITS, MAX_DRIFT_SECONDS
from mergelake.operators.schema import EngineError


class ClockError(EngineError):
    """A clock that can't be parsed, persisted or advanced."""


def ntp_now() -> int:
    """Now as 32.32 fixed-point seconds since 1970, counter bits cleared."""
    ns = time.time_ns()
    return (((ns // 10**9) << 32) + ((ns % 10**9) << 32) // 10**9) >> COUNTER_BITS << COUNTER_BITS


def parse(hlc: str) -> tuple[int, int]:
    """(time, node) of a complete clock string."""
    text, _, node = hlc.partition("/")
    if not (text.isascii() and text.isdigit() and int(text) < 1 << 64 and node and node[0] in "123456789abcdef" and len(node) <= 32 and set(node) <= set("0123456789abcdef")):
        raise ClockError(f"malformed clock {hlc!r}")
    return int(text), int(node, 16)


def node_of(device: str) -> int:
    """Node of a device UUID: its bytes read little-endian."""
    node = int.from_bytes(uuid.UUID(device).bytes, "little")
    if not node:
        raise ClockError("the nil UUID is no node")
    return node


class Clock:
    """Monotonic for one node. draw() is for one commit; advance() takes in remote clocks; floor restores after a restart."""

    def __init__(self, device: str, now: Callable[[], int] = ntp_now, last: str | None = None):
        self.device, self.node, self.now = device, node_of(device), now
        self.last = parse(last)[0] if last else 0

    def spelled(self, at: int) -> str:
        return f"{at}/{self.node:x}"

    def draw(self) -> str:
        now = self.now() >> COUNTER_BITS << COUNTER_BITS
        self.last = now if now > self.last else self.last + 1
        return self.spelled(self.last)

    def advance(self, hlc: str) -> None:
        at, _ = parse(hlc)
        if at > (now := self.now()) and (at - now) / (1 << 32) > MAX_DRIFT_SECONDS:
            raise ClockError(f"clock {hlc!r} is too far ahead")
        self.last = max(self.last, at)

    def current(self) -> str | None:
        return self.spelled(self.last) if self.last else None
