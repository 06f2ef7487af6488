"""CSV with a header: as many files as tasks, or one file for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Writes rows to a folder, replacing what it held. With by each key has a folder of its own with one file, sorted by order.

    A key's rows go through one task: keys are series, such as the bars of one ticker. Nulls are empty, times ISO.
    """
    out = rows
    if by:
        out = out.repartition(*by).sortWithinPartitions(*by, *(order or []))
    elif order:
        out = out.orderBy(*order)
    writer = out.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)
