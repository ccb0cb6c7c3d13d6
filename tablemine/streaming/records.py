"""Streams of JSON records: in, scored, out. Stateless, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablemine.domain import META, DISCRETE, CONTINUOUS, ColumnSpec, stamp
from tablemine.functions.ordering import column_quantiles
from tablemine.operators.evaluate import predict
from tablemine.operators.learners.base import Model
from tablemine.operators.neighbors import feature_vector
from tablemine.operators.outliers import forest_scorer, isolation_forest
from tablemine.sources.records import records_to_table, table_to_records


def records_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, *, lists: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Records arriving as JSON files under ``path``: one object per line, or with ``lists`` one list per line."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if lists:
        return records_to_table(reader.text(path), schema)
    return reader.schema(schema).json(path)


def predict_stream(stream: DataFrame, models: Sequence[Model]) -> DataFrame | None:
    """Predictions as added columns; models hold their fitted numbers, so nothing is kept between batches."""
    return predict(stream, models)


class AnomalyScorer:
    """Isolation forest fitted on a table, applied to a stream.

    The score limit is the exact ``1 - contamination`` quantile of the table's own scores.
    """

    def __init__(self, history: DataFrame, names: Sequence[str], *, key: Sequence[str], contamination: float = 0.1, seed: int = 42, **forest):
        self.vector = feature_vector(history, names)
        self.score = forest_scorer(isolation_forest(history, self.vector, seed=seed, key=key, **forest))
        scores = history.select(self.score(self.vector).alias("score"))
        self.limit = column_quantiles(scores, ["score"], [1 - contamination])["score"][1 - contamination]

    def flag(self, stream: DataFrame) -> DataFrame:
        scored = stream.withColumn("score", self.score(self.vector))
        flag = F.when(F.col("score") > self.limit, "yes").otherwise("no")
        return scored.select(
            *[c for c in scored.columns if c != "score"],
            stamp(F.col("score"), ColumnSpec("score", CONTINUOUS, META)),
            stamp(flag, ColumnSpec("Outlier", DISCRETE, META, ("no", "yes"))),
        )


def records_sink(stream: DataFrame, path: str, checkpoint: str, *, drain: bool = False) -> StreamingQuery:
    """Write each row as one JSON record per line, exactly once per the checkpoint. ``drain`` stops when all is read."""
    writer = table_to_records(stream).writeStream.format("text").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if drain else writer).start()
