"""What tasks read, from the session's own status store."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager


@contextmanager
def many_partitions(spark, n: int = 48):
    """Shuffles into n partitions that stay apart, so that a hot key stands out."""
    keys = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _stages(spark, action: Callable[[], object]) -> list:
    """The stages that ran during the action, as the status store has them."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def all_stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    before = max((s.stageId() for s in all_stages()), default=-1)
    action()
    return [s for s in all_stages() if s.stageId() > before]


def most_rows_read(spark, action: Callable[[], object]) -> int:
    """The most shuffled rows that one task of the action read."""
    most, store = 0, spark._jsc.sc().statusStore()
    for s in _stages(spark, action):
        if s.numTasks() and s.shuffleReadRecords():
            tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def bytes_read(spark, action: Callable[[], object]) -> int:
    """Bytes that the action's tasks read from files."""
    return sum(s.inputBytes() for s in _stages(spark, action))
