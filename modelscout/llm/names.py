"""Names for columns that an operator adds to a table whose columns it does not know."""
from __future__ import annotations

from collections.abc import Sequence


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores as make it differ from all ``taken`` (letter case does not count)."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
