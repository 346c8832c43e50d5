"""Models by role, what they cost together, a token budget and a breaker that all tasks share."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import SparkSession

from docloom.model.client import Backend, ModelError

FIELDS = ("calls", "failures", "unparsed", "tokens_in", "tokens_out")


class BudgetExceeded(RuntimeError):
    """The tokens of a run are used up; what was made so far stays."""


class Sums(AccumulatorParam):
    """Numbers by key, added up."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for key, n in b.items():
            a[key] = a.get(key, 0) + n
        return a


def readable(reply: str | None) -> bool:
    """Whether a reply holds JSON: fenced, whole, or between its outermost brackets."""
    text = reply or ""
    found = [m.group(1) for p in (r"(?s)```(?:json)?\s*(.*?)```", r"(?s)(\[.*\])", r"(?s)(\{.*\})") if (m := re.search(p, text))]
    for option in (text, *found):
        try:
            json.loads(option)
            return True
        except ValueError:
            continue
    return False


@dataclass
class Runtime(Backend):
    """Backends by role (generate, verify, vision); a role without one falls back to `generate`.

    Tasks add what their calls cost to one tally, which the driver reads before each wave of calls: a wave beyond the budget is
    refused, and so is one for a role that had `dead` failures or more and no success. Tasks that are run again count twice.
    """

    roles: dict[str, Backend] = field(default_factory=dict)
    budget: int | None = None
    dead: int = 5
    tally: Accumulator | None = None

    @classmethod
    def on(cls, spark: SparkSession, roles: Backend | dict[str, Backend], budget: int | None = None, dead: int = 5) -> "Runtime":
        named = roles if isinstance(roles, dict) else {"generate": roles}
        if "generate" not in named:
            raise ValueError("a backend for the role 'generate' is needed")
        return cls(named, budget, dead, spark.sparkContext.accumulator({}, Sums()))

    def __repr__(self) -> str:
        return f"Runtime({self.roles!r})"

    def of(self, role: str) -> Backend:
        return self.roles.get(role) or self.roles["generate"]

    def complete(self, prompt: str, temperature: float = 0.0, most: int = 1000, images: tuple[str, ...] = ()) -> str:
        return self.of("vision" if images else "generate").complete(prompt, temperature, most, images)

    def used(self) -> int:
        return sum(n for (_, name), n in self.tally.value.items() if name in ("tokens_in", "tokens_out"))

    def admit(self, role: str) -> None:
        """Refuses a wave of calls; called on the driver."""
        if self.budget is not None and self.used() >= self.budget:
            raise BudgetExceeded(f"{self.used()} of {self.budget} tokens are used")
        failures, calls = (self.tally.value.get((role, name), 0) for name in ("failures", "calls"))
        if failures >= self.dead and failures == calls:
            raise ModelError(f"all {calls} calls of the role {role!r} failed")

    def health(self) -> list[dict]:
        """One row a role: calls, failures, replies that couldn't be read, tokens."""
        value = self.tally.value
        return [{"role": role} | {name: value.get((role, name), 0) for name in FIELDS} for role in sorted({r for r, _ in value})]
