"""Session helper and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def build_session(app_name: str = "tarmac", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for.

    Nothing here is needed for right results; a cluster's own session works as
    well.  Shuffle partition counts are left to AQE coalescing, so the initial
    number may be set high for large inputs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a session in one process (``local``, not ``local-cluster``) may leave it
    unset; it gets a folder of its own, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    _own.append(tempfile.TemporaryDirectory(prefix="tarmac-", ignore_cleanup_errors=True))
    spark.conf.set("spark.checkpoint.dir", _own[-1].name)
    return _own[-1].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def ensure_checkpointing(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's choice."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


@contextmanager
def side_by_side(spark: SparkSession, steps: int) -> Iterator[Callable[..., Future]]:
    """``start(step, *arguments)`` runs up to ``steps`` steps at once in threads of the driver.

    Jobs of one step then use the cores that the last tasks of another leave idle.
    A step may wait for one that was started before it.  Leaving the block waits
    for all; if one fails, those not yet begun are left out and its error is raised.
    """
    started: list[Future] = []
    with ThreadPoolExecutor(steps) as pool:

        def start(step: Callable, *arguments) -> Future:
            started.append(pool.submit(inheritable_thread_target(spark)(step), *arguments))
            return started[-1]

        try:
            yield start
            for future in started:  # steps may start further ones meanwhile
                future.result()
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
