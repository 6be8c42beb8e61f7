"""Independent calls whose Spark jobs run side by side, so that one's last tasks and plans don't leave the cluster idle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Found = TypeVar("Found")

#: Calls at a time. It bounds what they keep in executors at once, whatever the number of calls.
AT_ONCE = 4


def together(calls: Sequence[Callable[[], Found]], at_once: int = AT_ONCE) -> list[Found]:
    """What the calls return, in their order. Threads have the caller's job group, tags and local properties.

    If calls fail, those not begun are left out, those begun end first, and the first error in their order is raised.
    """
    if len(calls) < 2 or at_once < 2:
        return [call() for call in calls]
    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(min(at_once, len(calls)), "tablewright") as pool:
        waiting = [pool.submit(inheritable_thread_target(session)(call) if session else call) for call in calls]
        try:
            return [x.result() for x in waiting]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
