"""Names for columns that an operator adds to a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it as long as it is one of ``taken``; column names don't tell upper from lower case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
