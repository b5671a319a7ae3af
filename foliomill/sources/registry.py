"""Named factories of engines, embedding models and stores."""

from __future__ import annotations

from collections.abc import Callable


class NotRegistered(LookupError):
    pass


class Registry:
    """Maps a key to a factory; one for each kind of port."""

    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, key: str, factory: Callable, replace: bool = False) -> None:
        if key in self._made and not replace:
            raise ValueError(f"{self.kind} {key!r} is registered already")
        self._made[key] = factory

    def is_registered(self, key: str | None) -> bool:
        return key in self._made

    def create(self, key: str | None, *args, **kwargs):
        if key is None or key not in self._made:
            raise NotRegistered(f"no {self.kind} {key!r}; there are {', '.join(sorted(self._made)) or 'none'}")
        return self._made[key](*args, **kwargs)


engines, models, stores = Registry("parsing engine"), Registry("embedding model"), Registry("vector store")
