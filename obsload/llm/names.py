"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
