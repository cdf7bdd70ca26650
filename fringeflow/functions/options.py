"""Options of a run: which differ from their defaults, as text for a file's history."""

from __future__ import annotations

import dataclasses
import shlex
from collections.abc import Callable, Iterable, Mapping
from typing import Any

Handler = Callable[[str, Any], list[str]]


def _plain(name: str, value: object) -> list[str]:
    return [f"--{name.replace('_', '-')}={value}"]


def _switch(name: str, value: object) -> list[str]:
    return [f"--{'' if value else 'no-'}{name.replace('_', '-')}"]


BY_TYPE: dict[type, Handler] = {bool: _switch, str: _plain, int: _plain, float: _plain}


def changed(options: object) -> dict[str, Any]:
    """Fields of a dataclass whose value isn't their default."""
    out = {}
    for f in dataclasses.fields(options):
        default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
        if (value := getattr(options, f.name)) != default:
            out[f.name] = value
    return out


def unparse(options: object, exclude: Iterable[str] = (), by_name: Mapping[str, Handler] = {}, by_type: Mapping[type, Handler] = {}) -> list[str]:
    """The arguments that set ``options`` so: a handler by a field's name, else by its value's type; TypeError where there is none."""
    types, out = BY_TYPE | dict(by_type), []
    for name, value in changed(options).items():
        if name in set(exclude):
            continue
        handler = by_name.get(name) or types.get(type(value))
        if handler is None:
            raise TypeError(f"no way to write {name}, a {type(value).__name__}")
        out += handler(name, value)
    return out


def history(options: object, **more: Any) -> str:
    """A line for HISTORY: all that differs from the defaults, quoted as a shell wants it."""
    return "Command line options: " + " ".join(shlex.quote(x) for x in unparse(options, **more))
