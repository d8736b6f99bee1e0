"""Recursive queries: UNION ALL by levels, UNION to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tesselon.sources.scratch import stored

#: Levels after which a recursion counts as endless.
MAX_LEVELS = 10_000


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], *, keep_all: bool = False, max_levels: int = MAX_LEVELS) -> DataFrame:
    """WITH RECURSIVE: each level is ``step`` of the one before; with UNION only rows not seen before go on.

    Every level is written to the shared folder, so lineage does not grow and a lost executor costs one level.
    """
    level = stored(seed if keep_all else seed.distinct())
    levels = [level]
    for _ in range(max_levels):
        new = step(level)
        if not keep_all:
            seen = levels[0]
            for old in levels[1:]:
                seen = seen.unionAll(old)
            new = new.subtract(seen)
        level = stored(new)
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) % 16 == 0:  # few inputs for the next subtraction
            merged = levels[0]
            for old in levels[1:]:
                merged = merged.unionAll(old)
            levels = [stored(merged)]
    else:
        raise RecursionError(f"recursion over {max_levels} levels")
    out = levels[0]
    for old in levels[1:]:
        out = out.unionAll(old)
    return out
