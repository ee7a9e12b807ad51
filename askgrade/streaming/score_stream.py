"""Scoring a stream of questions (M14): stateless, same expressions as the batch."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from askgrade.operators.scoring import score_questions
from askgrade.schemas import SCORING_INPUT


def question_stream(
    spark: SparkSession, path: str, source: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """New files of questions ``(Id, Body)`` in a folder."""
    reader = spark.readStream.schema(SCORING_INPUT).format(source)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_scoring(
    model: PipelineModel,
    questions: DataFrame,
    output: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Append scores to parquet files; the checkpoint makes a restart exactly-once."""
    writer = (
        score_questions(model, questions)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
