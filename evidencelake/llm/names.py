"""Names for columns that operators add to a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def moved(frame: DataFrame, *names: str) -> DataFrame:
    """The frame with any columns of these names moved to free ones, with further underscores before them."""
    for name in frame.columns:
        if name.lower() in names:
            frame = frame.withColumnRenamed(name, free_name(frame, f"_{name}"))
    return frame
