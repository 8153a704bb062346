"""Sends this subpackage's functions to the executors by value, so that they need no copy of it."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Pickle what the module ``name`` defines by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_wide(key: tuple, make: Callable):
    """What ``make()`` gave for ``key`` when this Python process first asked, so that a later task of a reused worker has it too."""
    kept = vars(sys.modules.setdefault("_phrasemine_worker", ModuleType("_phrasemine_worker")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


ship(__name__)
