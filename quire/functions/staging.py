"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession

#: Requests that are sent to every task at a time, and characters of them.
MOST_REQUESTS, MOST_CHARACTERS = 10_000, 1_000_000


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under `spark.checkpoint.dir`; under a temporary folder where that is unset and the master local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it back, which ends its lineage and keeps its plan short."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], text: str | None = None) -> DataFrame:
    """The answers to all requests, worked out for MOST_REQUESTS of them at a time, and MOST_CHARACTERS of their column `text`.

    Above that each block's answers are written before the next block is read, so that the
    driver holds one block. A request that is longer by itself is a block of its own.
    """
    first = requests.limit(MOST_REQUESTS + 1).selectExpr("count(*) AS n", f"coalesce(sum(length({text})), 0) AS characters" if text else "0L AS characters").first()
    if first["n"] <= MOST_REQUESTS and first["characters"] <= MOST_CHARACTERS:
        return answer(requests)
    spark, kept, block, characters = requests.sparkSession, [], [], 0

    def settle() -> None:
        kept.append(staged(answer(spark.createDataFrame(block, requests.schema)), "answers"))

    # written first: a block is cut from rows that no longer change
    for row in staged(requests, "requests").toLocalIterator():
        size = len(row[text] or "") if text else 0
        if block and (len(block) == MOST_REQUESTS or characters + size > MOST_CHARACTERS):
            settle()
            block, characters = [], 0
        block.append(row)
        characters += size
    if block:
        settle()
    return reduce(DataFrame.unionByName, kept)
