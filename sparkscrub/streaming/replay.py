"""A frozen recipe on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.steps import apply_step
from .repeats import without_duplicates


def streamable(recipe: list[dict]) -> bool:
    """Whether every step can follow a stream. Medians of groups are a table the recipe names. Duplicates are dropped by keyed state; with
    columns left out of the comparison the smallest of the duplicates stays, which is only known at the end, so that needs the whole table."""
    return all(s["tipo"] != "duplicados" or not s.get("ignorar") for s in recipe)


def replay(stream: DataFrame, recipe: list[dict]) -> DataFrame:
    if not streamable(recipe):
        raise ValueError("la receta quita duplicados sin comparar todas las columnas: necesita toda la tabla")
    for step in recipe:
        stream = without_duplicates(stream) if step["tipo"] == "duplicados" else apply_step(stream, step)
    return stream


def replay_files(spark: SparkSession, source: str, schema: StructType, recipe: list[dict], target: str,
                 checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Clean every new Parquet file below `source` into `target`; exactly once through the checkpoint folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (replay(stream, recipe).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target))
