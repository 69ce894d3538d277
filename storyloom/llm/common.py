"""What the operators of this subpackage share: reading, tables that cut lineage (staged), text normal forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storyloom.operators.scratch import kept as staged

__all__ = ["ascii_lower", "let", "map_texts", "staged", "strip_white", "table", "words_of"]

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay, unlike lower()."""
    return F.translate(text, _UPPER, _UPPER.lower())


def strip_white(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-white characters; empty for null and blank texts."""
    bare = strip_white(text)
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, inside one expression (so that CASE WHEN can still skip it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_texts(docs: DataFrame, id_col: str, text_col: str, made: str, function, *, step: int = 500) -> DataFrame:
    """id_col and the columns of the DDL string `made`, which function(texts) gives as {column: values}.

    function gets whole texts (null: None), at most `step` at a time, in Arrow batches inside the tasks. Ids pass
    through untouched, so nulls and repeats stay. Only these two columns are read, whatever others are called.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = function(part.column(1).to_pylist())
                columns = [pa.array(values[field.name], field.type) for field in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
