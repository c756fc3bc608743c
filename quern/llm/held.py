"""What a Python worker keeps between tasks: one large object at a time.

Spark reuses its Python workers for whatever runs next, so a vocabulary of one
operator would otherwise stay beside the model of another.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_held: list[tuple[Hashable, Any]] = []


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of ``key``, made unless it is the one that is held; the one before is let go first."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]


def nothing() -> None:
    """Let go of what is held."""
    _held.clear()
