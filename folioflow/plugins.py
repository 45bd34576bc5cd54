"""Named plugins: sources, formats, sinks, extractors of pages and layouts of documents.

What a plugin of each kind must be: a source is a class with ``load``; a format has ``read`` or ``write``; a sink is a
class made from data and settings with ``write``; an extractor is a function of a page, its address and its text; a
layout is a sign and a function of documents."""

from __future__ import annotations

from collections.abc import Callable

from .sources.records import FolioError

REGISTRY: dict[str, dict[str, object]] = {"source": {}, "format": {}, "sink": {}, "extractor": {}, "layout": {}}


def register(kind: str, name: str) -> Callable:
    """Put a class, function or object under a name, any case."""

    def add(thing):
        REGISTRY[kind][name.lower()] = thing
        return thing

    return add


def plugin(kind: str, name: str):
    try:
        return REGISTRY[kind][name.lower()]
    except KeyError:
        raise FolioError(f"no {kind} named {name}") from None


def names(kind: str) -> list[str]:
    return sorted(REGISTRY[kind])
