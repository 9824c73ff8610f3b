"""Users' sentence splitters and file processors.

A registry lives in the driver's Python; what is registered when a plan is made is carried to the
executors with it, so later changes don't touch plans that are there already.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from typing import Any

from ..errors import CallbackError, InvalidInputError


class Registry:
    """Callbacks by name: splitters by language, processors by extension."""

    def __init__(self, what: str, check: Callable[[str], str | None]):
        self.what, self._check = what, check
        self._held: dict[str, tuple[str, Callable]] = {}

    def register(self, *names: Any, name: str | None = None):
        """As a decorator, register("xx"), or called with names and a function."""
        if names and callable(names[-1]) and not isinstance(names[-1], str):
            return self._add(names[-1], names[:-1], name)
        return lambda f: self._add(f, names, name)

    def _add(self, f: Callable, names: Iterable[str], label: str | None) -> Callable:
        names = list(names)
        if not names:
            raise InvalidInputError(f"A {self.what} needs a key to be registered under")
        for n in names:
            if not isinstance(n, str) or not n:
                raise InvalidInputError(f"Keys are non-empty strings, not {n!r}")
            if problem := self._check(n):
                raise InvalidInputError(problem)
        needed = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        if len(needed) != 1:
            raise InvalidInputError(f"A {self.what} takes exactly one argument, not {len(needed)}")
        label = label or getattr(f, "__name__", None)
        if not label or label == "<lambda>":
            raise InvalidInputError(f"A lambda needs a name to be registered as a {self.what}")
        for n in names:
            self._held[n] = (label, f)
        return f

    def unregister(self, *names: str) -> None:
        for n in names:
            self._held.pop(n, None)

    def clear(self) -> None:
        self._held.clear()

    def is_registered(self, name: str) -> bool:
        return name in self._held

    def snapshot(self) -> dict[str, tuple[str, Callable]]:
        return dict(self._held)


def call_splitter(label: str, f: Callable, text: str) -> list[str]:
    """What a splitter gives for a text; anything but a list of strings is an error."""
    try:
        out = f(text)
    except Exception as e:
        raise CallbackError(f"Splitter {label!r} failed on text starting with {text[:100]!r}: {e}") from e
    if not isinstance(out, list) or not all(isinstance(s, str) for s in out):
        raise CallbackError(f"Splitter {label!r} must return a list of strings, not {type(out).__name__}")
    return out


def call_processor(label: str, f: Callable, path: str) -> tuple[list[str], dict]:
    """(sections, metadata) that a processor gives for a file."""
    try:
        out = f(path)
    except Exception as e:
        raise CallbackError(f"Processor {label!r} failed on {path}: {e}") from e
    if not isinstance(out, tuple) or len(out) != 2 or not isinstance(out[1], dict):
        raise CallbackError(f"Processor {label!r} must return (text or texts, metadata dict)")
    texts = [out[0]] if isinstance(out[0], str) else out[0]
    try:
        texts = list(texts)
    except TypeError as e:
        raise CallbackError(f"Processor {label!r} must return text or an iterable of texts") from e
    if not all(isinstance(t, str) for t in texts):
        raise CallbackError(f"Processor {label!r} returned sections that aren't text")
    return texts, out[1]


splitters = Registry("sentence splitter", lambda n: None)
processors = Registry("file processor", lambda n: None if n.startswith(".") else f"An extension starts with a dot: {n!r}")
