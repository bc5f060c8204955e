"""Column names made unique; a name that a file carries always stays with the first column that carries it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, count


def unique_columns(raw: Sequence[str | None]) -> tuple[list[str], list[dict]]:
    """One name for each column, and what had to be renamed (``from``, ``to``, ``at``: the position from 1).

    The first column with a name keeps it. The others look for one: a blank from ``col_<position>`` on, a repeat from
    its own name with ``_2`` on, and each takes the first that no column has; blanks choose before repeats.
    """
    given = [str(name or "") for name in raw]
    chosen: dict[str, int] = {}
    for at, name in enumerate(given):
        if name:
            chosen.setdefault(name, at)
    without = [at for at, name in enumerate(given) if chosen.get(name) != at]
    for at in sorted(without, key=lambda at: given[at] != ""):
        stem = given[at] or f"col_{at + 1}"
        wishes = chain([stem], (f"{stem}_{n}" for n in count(2)))
        chosen[next(w for w in wishes if w not in chosen)] = at
    names = sorted(chosen, key=chosen.__getitem__)
    return names, [{"from": given[at], "to": names[at], "at": at + 1} for at in sorted(without)]
