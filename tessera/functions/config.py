"""Plain configuration: nested dicts merged and filtered in the driver, and checks of arguments."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from contextlib import contextmanager


def merged(base: dict, over: dict, on_exist: str = "overwrite") -> dict:
    """base with the values of over, nested dicts merged. A value that both have: overwrite, ignore (base stays) or raise."""
    if on_exist not in ("overwrite", "ignore", "raise"):
        raise ValueError(f"on_exist is overwrite, ignore or raise, not {on_exist!r}")
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v, on_exist)
        elif k not in out or on_exist == "overwrite":
            out[k] = copy.deepcopy(v)
        elif on_exist == "raise":
            raise KeyError(f"{k!r} is there already")
    return out


def with_override(config: dict, assignment: str) -> dict:
    """config with one "a.b.c=value"; numbers, true, false and null are read as such."""
    path, sep, raw = assignment.partition("=")
    if not sep:
        raise ValueError(f"an override is path=value, not {assignment!r}")
    value: object = {"true": True, "false": False, "null": None}.get(raw.lower(), raw)
    if isinstance(value, str):
        for kind in (int, float):
            try:
                value = kind(raw)
                break
            except ValueError:
                continue
    over: object = value
    for k in reversed(path.split(".")):
        over = {k: over}
    return merged(config, over)


def only_tasks(config: dict, names: Iterable[str], sections: Iterable[str]) -> dict:
    """config whose named sections keep the entries of these tasks only."""
    names, out = set(names), copy.deepcopy(config)
    for path in sections:
        *front, last = path.split(".")
        at = out
        for k in front:
            at = at[k]
        at[last] = {k: v for k, v in at[last].items() if k in names}
    return out


def checked_columns(available: Iterable[str], chosen: str | Iterable[str], extra: Iterable[str] = ()) -> list[str]:
    """chosen as a list; an error for a name that is neither there nor extra."""
    wanted = [chosen] if isinstance(chosen, str) else list(chosen)
    if missing := set(wanted) - set(available) - set(extra):
        raise ValueError(f"no columns {sorted(missing)}")
    return wanted


def as_list(value, kind: type | None = None, cast: bool = False) -> list:
    """None: empty; one value: a list of it; elements checked against, or cast to, a type."""
    out = [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]
    if kind is None:
        return out
    if cast:
        return [kind(v) for v in out]
    if bad := [v for v in out if not isinstance(v, kind)]:
        raise TypeError(f"not {kind.__name__}: {bad}")
    return out


@contextmanager
def safe(name: str, raise_error: bool = True):
    """Runs a block; an error is printed with its name, and raised again unless told otherwise."""
    try:
        yield
    except Exception as e:
        print(f"{name} failed: {type(e).__name__}: {e}")
        if raise_error:
            raise
