"""Driver-side helpers: a bounded result cache and a timer."""

from __future__ import annotations

import functools
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable


class ResultCache:
    """Least-recently-used results with counters of hits and misses."""

    def __init__(self, max_size: int = 128):
        if max_size < 1:
            raise ValueError("max_size must be positive")
        self.max_size, self.hits, self.misses = max_size, 0, 0
        self._kept: OrderedDict[Hashable, object] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], object]):
        """The kept result, or that of ``make``; what raises is a miss and isn't kept."""
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]
        self.misses += 1
        value = self._kept[key] = make()
        if len(self._kept) > self.max_size:
            self._kept.popitem(last=False)
        return value

    def clear(self) -> None:
        self._kept.clear()
        self.hits = self.misses = 0


def lru_cache(max_size: int = 128, key: Callable[..., Hashable] | None = None):
    """Decorator over ``ResultCache``; ``key`` maps the call's arguments to a cache key."""

    def wrap(f):
        cache = ResultCache(max_size)

        @functools.wraps(f)
        def call(*args, **kwargs):
            k = key(*args, **kwargs) if key else (args, tuple(sorted(kwargs.items())))
            return cache.get(k, lambda: f(*args, **kwargs))

        call.cache = cache
        call.cache_clear = cache.clear
        return call

    return wrap


def timed(f):
    """Decorator that leaves the seconds of the latest call in ``last_duration``."""

    @functools.wraps(f)
    def call(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            call.last_duration = time.perf_counter() - began

    call.last_duration = None
    return call
