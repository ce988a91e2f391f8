"""Several pieces of work side by side on one session, so that one that fails or takes too long does not stop the others."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

#: Seconds between two attempts to cancel the jobs of work that is over its time.
AGAIN_S = 0.5


@dataclass
class Outcome:
    """What became of one piece of work; ``warning`` is None if it succeeded."""

    value: Any = None
    warning: str | None = None
    message: str = ""
    error: Exception | None = None


def _cancel(spark: SparkSession, threads: dict[str, InheritableThread], tags: dict[str, str]) -> None:
    # work that is between two jobs starts another one, so it is told until its thread ends
    while any(t.is_alive() for t in threads.values()):
        for name, thread in threads.items():
            if thread.is_alive():
                spark.sparkContext.cancelJobsWithTag(tags[name])
        for thread in threads.values():
            thread.join(AGAIN_S / len(threads))


def run_apart(
    spark: SparkSession, work: dict[str, Callable[[], Any]], time_limit: float | None = None
) -> dict[str, Outcome]:
    """Run every piece in a thread of its own and give what each returned.

    The jobs of a piece carry a tag of their own and, where the session schedules fairly, share a pool. After
    ``time_limit`` seconds (None: no limit) the jobs of what is left are cancelled. Work must do its jobs inside, e.g.
    write its result; a lazy result would fail later, outside.
    """
    run = uuid.uuid4().hex
    tags = {name: f"{run}-{name}" for name in work}
    outcomes = {name: Outcome() for name in work}
    late: set[str] = set()

    def one(name: str, build: Callable[[], Any]) -> None:
        spark.sparkContext.addJobTag(tags[name])
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            value = build()
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            if name not in late:
                log.warning("%s failed: %s", name, str(e).partition("\n")[0])
                outcomes[name] = Outcome(None, f"{name}: failed ({type(e).__name__})", str(e), e)
        else:
            outcomes[name] = Outcome(value)
            late.discard(name)

    threads = {name: InheritableThread(target=one, args=(name, build)) for name, build in work.items()}
    for thread in threads.values():
        thread.start()
    end = None if time_limit is None else time.monotonic() + time_limit
    for thread in threads.values():
        thread.join(None if end is None else max(0.0, end - time.monotonic()))
    late |= {name for name, thread in threads.items() if thread.is_alive()}
    _cancel(spark, threads, tags)
    for name in late:
        outcomes[name] = Outcome(None, f"{name}: stopped after {time_limit:g} s", "time limit")
    return outcomes
