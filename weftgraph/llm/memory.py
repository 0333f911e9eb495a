"""What a Python worker remembers from one task to the next."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def forget() -> None:
    """Drop all that the worker remembers."""
    if _held:
        _held.clear()
        gc.collect()


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object for `key`; one of another key goes, so that what operators remember does not add up."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]
