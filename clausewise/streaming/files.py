"""The lint plan over a stream of documents.

Parsing and sentence rules are document-local, so a stream needs no state: each micro-batch of files is linted
as a batch and appended to the sink. Block rules see whole documents, because a file arrives whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clausewise.options import Options
from clausewise.plans.lint import lint


def documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (path, text) from Parquet files that arrive in ``path``."""
    return spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def lint_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that gives each batch's findings to ``sink(findings, batch_id)``.

    A batch that is run again after a failure has the same id: a sink that overwrites by id keeps results whole.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(lint(batch, options), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
