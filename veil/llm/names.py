"""Names of helper columns that no column of a table has."""

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
