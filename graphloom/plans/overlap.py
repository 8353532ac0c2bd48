"""How far the tasks of a piece of work ran side by side, from the figures that Spark keeps of its stages."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Overlap:
    """``overlap``: CPU seconds of all tasks in a second of wall clock; above 1 some ran at once."""

    wall_s: float = 0.0
    cpu_s: float = 0.0
    run_s: float = 0.0
    stages: int = 0
    tasks: int = 0

    @property
    def overlap(self) -> float:
        return self.cpu_s / self.wall_s if self.wall_s else 0.0


def _stages(spark: SparkSession) -> list:
    """Finished stages that Spark still remembers (spark.ui.retainedStages), as its status store has them."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    stages = [found.apply(k) for k in range(found.size())]
    return [s for s in stages if s.status().toString() == "COMPLETE"]


class measure_overlap:
    """``with measure_overlap(spark) as o: ...``: afterwards ``o`` has the figures of the stages that ran in it.

    Only JVM time counts as CPU time: what Python workers use is in ``run_s``, the time that tasks took.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Overlap:
        self.before = {(s.stageId(), s.attemptId()) for s in _stages(self.spark)}
        self.found, self.began = Overlap(), time.perf_counter()
        return self.found

    def __exit__(self, kind, value, trace) -> None:
        self.found.wall_s = time.perf_counter() - self.began
        for s in _stages(self.spark):
            if (s.stageId(), s.attemptId()) not in self.before:
                self.found.stages += 1
                self.found.tasks += s.numCompleteTasks()
                self.found.cpu_s += s.executorCpuTime() / 1e9
                self.found.run_s += s.executorRunTime() / 1e3
