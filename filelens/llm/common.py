"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.operators.common import materialized

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A top-level column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_column(spark, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a row key in column ``name``. The key comes
    from the writing task, so it is only fixed because the table is written."""
    return materialized(df.withColumn(name, F.monotonically_increasing_id()), name.strip("_"))
