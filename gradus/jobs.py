"""Jobs of tenants: one at a time and in order for each tenant, several tenants at once, each in its own pool and job group of Spark."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class TenantJobs:
    """``submit(tenant, work, ...)`` returns a future of ``work(...)``.

    A tenant's next job starts when the one before has ended, whether well or not, so two runs never write one tenant's tables at once.
    Jobs of different tenants share the cluster by pools (fairly where ``spark.scheduler.mode`` is FAIR). ``cancel`` stops the
    running job of a tenant and drops what waits.
    """

    def __init__(self, spark: SparkSession, at_once: int = 4) -> None:
        self.spark = spark
        self._threads = ThreadPoolExecutor(at_once, thread_name_prefix="tenant")
        self._lock = threading.Lock()
        self._waiting: dict[str, deque] = {}

    def submit(self, tenant: str, work: Callable[..., Any], *args: Any, **options: Any) -> Future:
        job: tuple = (Future(), work, args, options)
        with self._lock:
            queue = self._waiting.get(tenant)
            if queue is not None:  # a job of this tenant is running and takes the next one up
                queue.append(job)
                return job[0]
            self._waiting[tenant] = deque([job])
        self._threads.submit(inheritable_thread_target(self.spark)(self._run), tenant)
        return job[0]

    def _run(self, tenant: str) -> None:
        """One job; the tenant's next goes to the end of the line of all tenants."""
        context = self.spark.sparkContext
        with self._lock:
            future, work, args, options = self._waiting[tenant].popleft()
        if future.set_running_or_notify_cancel():
            context.setLocalProperty("spark.scheduler.pool", tenant)
            context.setJobGroup(f"tenant {tenant}", f"job of {tenant}", interruptOnCancel=True)
            try:
                future.set_result(work(*args, **options))
            except BaseException as error:  # the future carries it
                future.set_exception(error)
        with self._lock:
            if not self._waiting[tenant]:
                del self._waiting[tenant]
                return
        self._threads.submit(inheritable_thread_target(self.spark)(self._run), tenant)

    def cancel(self, tenant: str) -> int:
        """The number of waiting jobs that were dropped; the running one is asked to stop."""
        with self._lock:
            dropped = [job for job in self._waiting.get(tenant, ()) if job[0].cancel()]
        self.spark.sparkContext.cancelJobGroup(f"tenant {tenant}")
        return len(dropped)

    def close(self) -> None:
        """Waits until every job that was submitted has ended."""
        while True:
            with self._lock:
                busy = [job[0] for queue in self._waiting.values() for job in queue]
                running = bool(self._waiting)
            if not running:
                break
            for future in busy:
                future.exception() if not future.cancelled() else None
            threading.Event().wait(0.01)
        self._threads.shutdown()
