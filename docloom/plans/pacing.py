"""A service's token budget, dealt to the tasks that call it."""

import time
from collections.abc import Callable
from dataclasses import dataclass

#: Bytes of text for each token that is counted on: services count fewer.
BYTES_PER_TOKEN = 3


def tokens_of(*texts: str) -> int:
    """What a service counts for texts, at most but for odd scripts."""
    return sum(-(-len(t.encode(errors="replace")) // BYTES_PER_TOKEN) for t in texts)


@dataclass(frozen=True)
class RateLimit:
    """tokens in any stretch of so many seconds, of all tasks together; largest: the tokens of a request at most."""

    tokens: int
    seconds: float = 60.0
    largest: int = 4096

    def tasks(self, cores: int) -> int:
        """How many tasks may call at a time: half of the budget at most is set aside for the last request of each."""
        return max(1, min(cores, self.tokens // (2 * self.largest)))

    def pace(self, tasks: int) -> "Pace":
        """One task's share. Requests that start within the seconds are those that its pace allows and one more, so the largest
        request of each task is taken off the budget."""
        return Pace(max(self.tokens - tasks * self.largest, self.tokens / 2) / tasks / self.seconds)


class Pace:
    """Calls start as far from each other as the tokens of the earlier one take at so many a second."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.free = rate, clock, sleep, None

    def wait(self, tokens: int) -> None:
        now = self.clock()
        if self.free is not None and self.free > now:
            self.sleep(self.free - now)
            now = max(self.free, self.clock())
        self.free = now + tokens / self.rate
