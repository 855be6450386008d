"""Names that do not clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def typed_path(text: str) -> str:
    """A path as one types or pastes it: without quotes around it, with / for \\."""
    return text.strip().strip("\"'").replace("\\", "/").rstrip("/").strip()
