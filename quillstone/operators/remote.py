"""The model boundary: a request table goes in, a response table comes out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: retries and waits of the task
TRIES, LONGEST_WAIT = 3, 8.0


def attempt(call: Callable[[str], str], content: str, tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> str | None:
    """The reply, or None after ``tries`` failures; waits double up to ``LONGEST_WAIT`` seconds."""
    for k in range(tries):
        try:
            return call(content)
        except Exception:  # noqa: BLE001  any failure of the service is retried
            if k + 1 < tries:
                pause(min(LONGEST_WAIT, 2.0**k))
    return None


def ask(requests: DataFrame, call: Callable[[str], str], concurrency: int = 8, tries: int = TRIES) -> DataFrame:
    """(key, text, failed) for requests (key, user_content): bounded concurrency inside every task.

    A request that fails for good has the text ''. Materialise the result before checking it with ``all_failed``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                replies = list(pool.map(lambda c: attempt(call, c, tries), batch["user_content"]))
                yield pd.DataFrame({"key": batch["key"], "text": [r or "" for r in replies], "failed": [r is None for r in replies]})

    kind = requests.schema["key"].dataType.simpleString()
    return requests.select("key", "user_content").mapInPandas(run, f"key {kind}, text string, failed boolean")


def all_failed(responses: DataFrame) -> bool:
    """Whether there were requests and none succeeded: the one case that stops a run."""
    r = responses.agg(F.count("*").alias("n"), F.count_if("failed").alias("bad")).collect()[0]
    return r["n"] > 0 and r["n"] == r["bad"]
