"""Tables that are made when they are first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyTables(Mapping):
    """Tables by name, each made once by its function, which gets these tables."""

    def __init__(self, make: Mapping[str, Callable[[Mapping], DataFrame]]):
        self._make, self._made = dict(make), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)

    def __contains__(self, name: object) -> bool:
        return name in self._make
