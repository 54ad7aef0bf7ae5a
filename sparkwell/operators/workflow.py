"""Driver-side control: steps over DataFrames, tools, a bounded reasoning loop, and an event queue.

Nothing here touches rows on the driver: steps build plans, and the loop and the queue handle a handful of messages.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def branched(key: Column, steps: dict[Any, Step], other: Step | None = None) -> Step:
    """Each row by the step that its key names; rows of other keys by `other`, or not at all."""

    def run(df: DataFrame) -> DataFrame:
        known = F.coalesce(key.isin(list(steps)), F.lit(False))
        parts = [df.where(key == k).transform(s) for k, s in steps.items()]
        parts += [df.where(~known).transform(other)] if other else []
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return run


def mapped(**columns: Column) -> Step:
    return lambda df: df.withColumns(columns)


def parallel(*steps: Step) -> Step:
    """All steps over the same rows, their results together."""
    return lambda df: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.transform(s) for s in steps])


def fallback(*steps: Callable[..., Any]) -> Callable[..., Any]:
    """The first step that doesn't fail."""

    def run(*args, **options):
        for i, step in enumerate(steps):
            try:
                return step(*args, **options)
            except Exception:
                if i + 1 == len(steps):
                    raise
        raise AssertionError

    return run


def chained(*steps: Step) -> Step:
    return lambda df: reduce(lambda d, s: d.transform(s), steps, df)


def conditional(condition: Column, step: Step) -> Step:
    """The step for rows that meet the condition; the others pass unchanged (columns that the step adds are null there)."""
    return lambda df: df.where(condition).transform(step).unionByName(df.where(~condition | condition.isNull()), allowMissingColumns=True)


def filtered(condition: Column) -> Step:
    return lambda df: df.where(condition)


def retried(step: Callable[..., Any], attempts: int = 3, wait: float = 1.0) -> Callable[..., Any]:
    """The same function, called again after a failure with a fixed wait."""

    def run(*args, **options):
        for i in range(attempts):
            try:
                return step(*args, **options)
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(wait)
        raise AssertionError

    return run


@dataclass(frozen=True)
class Tool:
    """A named function from keyword arguments to a result that can be shown as text."""

    name: str
    description: str
    call: Callable[..., Any]


def reasoning_messages(
    tools: list[Tool], history: list[tuple[str, str]], steps: list[tuple[str, str]], context: str = "", observer: str = "user"
) -> list[tuple[str, str]]:
    """(role, text) messages for a model that reasons with tools: what it may use, the history, then its steps.

    steps are (kind, text); an observation is said by `observer`, all others by the assistant.
    """
    listing = "\n".join(f"> Tool Name: {t.name}\nTool Description: {t.description}" for t in tools)
    head = f"You can use these tools: {', '.join(t.name for t in tools)}\n{listing}\n"
    if context:
        head += f"\nHere is some context to help you answer the question and plan:\n{context}\n"
    said = [(observer if kind == "observation" else "assistant", text) for kind, text in steps]
    return [("system", head), *history, *said]


_ACTION = re.compile(r"(?s)Action:\s*([^\n(]+?)\s*\n+Action Input:\s*(\{.*?\})\s*(?:\n|$)")
_ANSWER = re.compile(r"(?s)Answer:\s*(.*)$")


def reason(question: str, tools: list[Tool], complete: Callable[[str], str], most: int = 10) -> tuple[str, list[tuple[str, str]]]:
    """(answer, steps): thought, action and observation until the model answers, at most `most` times."""
    known = {t.name: t for t in tools}
    listing = "\n".join(f"> {t.name}: {t.description}" for t in tools)
    said, steps = "", []
    for _ in range(most):
        text = complete(f"Tools:\n{listing}\n\nQuestion: {question}\n{said}")
        if (action := _ACTION.search(text)) is None:
            answer = _ANSWER.search(text)
            return (answer[1] if answer else text).strip(), steps
        name, raw = action[1], action[2]
        try:
            try:
                arguments = json.loads(raw)
            except ValueError:
                arguments = json.loads(raw.replace("'", '"'))
            seen = str(known[name].call(**arguments)) if name in known else f"no tool is called {name}"
        except Exception as error:  # what went wrong is told to the model
            seen = f"Error: {error}"
        steps.append((name, seen))
        said += f"{text.strip()}\nObservation: {seen}\n"
    raise RuntimeError(f"no answer after {most} steps")


@dataclass(frozen=True)
class Event:
    kind: str
    data: Any = None


@dataclass
class Workflow:
    """Handlers by kind of event. Events are handled in order of arrival; handlers return events to follow."""

    handlers: dict[str, list[Callable[[Event], list[Event]]]] = field(default_factory=dict)
    capacity: int = 1000
    timeout: float = 60.0
    attempts: int = 1

    def on(self, kind: str, handler: Callable[[Event], list[Event]]) -> None:
        self.handlers.setdefault(kind, []).append(handler)

    def run(self, start: Event, stop: str = "stop") -> Any:
        """The data of the first stop event, or None when no event is left."""
        queue, end = deque([start]), time.monotonic() + self.timeout
        while queue:
            event = queue.popleft()
            if event.kind == stop:
                return event.data
            if time.monotonic() > end:
                raise TimeoutError(f"no {stop} event within {self.timeout} s")
            for handler in self.handlers.get(event.kind, []):
                queue.extend(retried(handler, self.attempts, 0.0)(event) or [])
                if len(queue) > self.capacity:
                    raise OverflowError(f"more than {self.capacity} events wait")
        return None
