"""Lookups as Columns."""

from pyspark.sql import Column, DataFrame, functions as F


def look_up(table: dict, key: Column) -> Column:
    """The entry of key, or null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(key.cast("string"), F.lit("")))


def routed(df: DataFrame, routes: dict[tuple[str, str], tuple], source: Column, key: Column, columns: list[str]) -> DataFrame:
    """df with columns of the route of (source, key), null where there is none. routes is a table of fixed values, so it goes to all tasks."""
    rows = df.sparkSession.createDataFrame([(*k, *v) for k, v in routes.items()], ", ".join(f"{c} string" for c in ("_source", "_key", *columns)))
    return df.withColumns({"_source": source, "_key": key}).join(F.broadcast(rows), ["_source", "_key"], "left").drop("_source", "_key")
