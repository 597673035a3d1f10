"""What a Python worker keeps from task to task: one thing at a time.

Spark uses workers again for later tasks, of other stages too. A model or vocabulary that was
built for one stage would otherwise stay beside those of all stages after it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from corpusloom.arrowmap import give_back

_kept: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, made once while ``key`` is the last one asked for in this worker."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Forget what is kept; for tasks that need memory for themselves."""
    if _kept:
        _kept.clear()
        give_back()
