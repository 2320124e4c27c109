"""One streaming query a source: each commits on its own, and one that fails stops no other."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .streams import Batch


@dataclass
class SourceRun:
    """What became of a source: batches that its query committed, and its error."""

    batches: int = 0
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


@dataclass
class Progress(StreamingQueryListener):
    """Counts committed batches by the query's name; only names of this run's sources are noted."""

    runs: dict[str, SourceRun] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (run := self.runs.get(event.progress.name)) is not None and event.progress.numInputRows:
            run.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_sources(spark: SparkSession, streams: Mapping[str, DataFrame], apply: Callable[[str], Batch], checkpoints: str) -> dict[str, SourceRun]:
    """Run every source to its end, all at once: ``apply(name)`` merges its batches, its checkpoint is ``checkpoints``/name.

    A source that fails keeps what it had committed and goes on from there when it is run
    again; the others are not touched.
    """
    progress = Progress({name: SourceRun() for name in streams})
    started: dict[str, StreamingQuery] = {}
    spark.streams.addListener(progress)
    try:
        for name, stream in streams.items():
            try:
                writer = stream.writeStream.queryName(name).foreachBatch(apply(name)).option("checkpointLocation", f"{checkpoints}/{name}")
                started[name] = writer.trigger(availableNow=True).start()
            except Exception as e:
                progress.runs[name].error = str(e)
        for name, query in started.items():
            try:
                query.awaitTermination()
            except Exception as e:
                progress.runs[name].error = str(e)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    return progress.runs
