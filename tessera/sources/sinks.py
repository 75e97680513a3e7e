"""Exports: nested records, flat tables with all columns, reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import tagged_union


def nested(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Each parent with its children as sorted arrays of structs under their names; none gives an empty array."""
    out = parents
    for name, child in children.items():
        fields = [c for c in child.columns if c != key]
        grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def decoded_json(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Columns 'x_json' parsed into 'x' by their schema; unreadable text gives null."""
    for column, schema in schemas.items():
        df = df.withColumn(column.removesuffix("_json"), F.from_json(column, schema)).drop(column)
    return df


def write_csv(parts: dict[str, DataFrame], path: str) -> None:
    """All collections in one table: their union of columns, tagged by record_type."""
    tagged_union(parts).write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def markdown_table(header: list[str], rows: Column) -> Column:
    """A pipe table of an array of arrays of strings."""
    head = "| " + " | ".join(header) + " |\n|" + " --- |" * len(header)
    body = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.concat_ws("\n", F.lit(head), F.array_join(body, "\n"))


def markdown_cells(table: Column) -> Column:
    """The cells of a pipe table's rows, without its rule line."""
    lines = F.filter(F.split(table, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside the target, move the old files away, then the new ones in; a failure on the way leaves the old or the new files under one of the three names.

    An old table that an interrupted call left as ``path.old`` is put back first.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old, now = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"cannot rename {source} to {target}")

    if fs.exists(old) and not fs.exists(now):
        move(old, now)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(now):
        move(now, old)
    move(new, now)
    fs.delete(old, True)
