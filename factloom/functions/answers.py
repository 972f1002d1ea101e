"""What a language model answers: JSON out of prose, and facts out of shapes that were not asked for.

Plain Python, as it runs beside the model's callable in a worker; nothing here is on a path without a model.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

#: How often a call that fails is made, and the pause before it is made again, times the attempt.
ATTEMPTS, PAUSE = 2, 1.5
_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", re.S)

Ask = Callable[[str, str], str]


class CallFailed(Exception):
    """The model gave no answer."""


class Unparseable(Exception):
    """The answer holds no JSON; ``raw`` is the answer."""

    def __init__(self, message: str, raw: str):
        super().__init__(message)
        self.raw = raw


def parse_answer(raw: str) -> object:
    """the JSON value of an answer, also inside a code fence or behind words: what begins at the first bracket or
    brace. Control characters inside strings are allowed."""
    text = (m[1] if (m := _FENCE.match(raw)) else raw).strip()
    starts = [0, *sorted(i for i in (text.find("["), text.find("{")) if i > 0)[:1]]
    for at in starts:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except ValueError:
            continue
        if at or not text[end:].strip():
            return value
    raise Unparseable("no JSON in the answer", raw)


def call(ask: Ask, system: str, user: str, attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> object:
    """L1: the parsed answer. A timeout is not tried again, as it would take as long; any other failure is."""
    for attempt in range(1, attempts + 1):
        try:
            return parse_answer(ask(system, user))
        except Unparseable:
            raise
        except TimeoutError as e:
            raise CallFailed(f"timed out: {e}") from e
        except Exception as e:  # noqa: BLE001 - whatever the model's client raises
            if attempt == attempts:
                raise CallFailed(str(e)) from e
            sleep(pause * attempt)
    raise CallFailed("no attempt was made")


def as_facts(value: object) -> tuple[list[dict] | None, str | None]:
    """the list of facts, and how it was found if it was not one: a single fact, or the first list of objects under
    some key. None if there is none."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)], None
    if not isinstance(value, dict):
        return None, None
    if {"quote", "statement"} <= value.keys():
        return [value], "a single fact stood for a list"
    for key, inner in value.items():
        if isinstance(inner, list) and inner and all(isinstance(x, dict) for x in inner):
            return inner, f"the list stood under {key!r}"
    return None, None
