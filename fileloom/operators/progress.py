"""Progress of what Spark runs, told to a callback."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def watched(spark: SparkSession, progress: Callable[[int, int], None] | None, every: float = 0.5) -> Iterator[None]:
    """Tell ``progress`` (done, total) of the tasks of the stages that run inside, again and again and at the end."""
    if progress is None:
        yield
        return
    context, tag, over = spark.sparkContext, f"fileloom-{uuid.uuid4().hex}", threading.Event()
    tracker, seen = context.statusTracker(), {}

    def look() -> None:
        for job in tracker.getJobIdsForGroup(tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                found = tracker.getStageInfo(stage)
                if found and found.numTasks:
                    seen[stage] = (found.numCompletedTasks, found.numTasks)
        progress(sum(d for d, _ in seen.values()), sum(n for _, n in seen.values()))

    def loop() -> None:
        while not over.wait(every):
            look()

    before = context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", tag)
    teller = threading.Thread(target=loop, daemon=True)
    teller.start()
    try:
        yield
    finally:
        over.set()
        teller.join()
        context.setLocalProperty("spark.jobGroup.id", before)
        look()
