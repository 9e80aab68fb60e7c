"""Time budgets of single queries: what takes longer is cancelled by its tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds that a full-text and a fuzzy query may take by default.
FULL_TEXT, FUZZY = 5.0, 3.0


#: Seconds between two cancellations of what runs on beyond its budget, which may be between two jobs at the first.
AGAIN = 0.05


def _cancel_until(spark: SparkSession, tag: str, done: threading.Event) -> None:
    while not done.is_set():
        spark.sparkContext.cancelJobsWithTag(tag)
        done.wait(AGAIN)


def within[T](spark: SparkSession, seconds: float, run: Callable[[], T], otherwise: T | None = None) -> T | None:
    """run(), or `otherwise` if it takes more than `seconds`; its jobs are cancelled then, and no others. Its errors are raised."""
    tag, done, out = f"budget-{uuid.uuid4().hex}", threading.Event(), {}

    def tagged() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out["value"] = run()
        except BaseException as error:  # noqa: BLE001
            out["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)
            done.set()

    InheritableThread(target=tagged, daemon=True).start()
    if not done.wait(seconds):
        threading.Thread(target=_cancel_until, args=(spark, tag, done), daemon=True).start()
        return otherwise
    if "error" in out:
        raise out["error"]
    return out["value"]
