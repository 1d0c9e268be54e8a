"""Plug-ins by kind and name: loaders, normalizers, analyzers."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("loader", "normalizer", "analyzer")
_KNOWN: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def canonical(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Registers a function; loaders are (spark, **params) → DataFrame, the others (DataFrame, **params) → DataFrame."""

    def add(f: Callable) -> Callable:
        _KNOWN[kind][canonical(name)] = f
        return f

    return add


def get(kind: str, name: str) -> Callable:
    try:
        return _KNOWN[kind][canonical(name)]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(sorted(_KNOWN[kind]))}") from None
