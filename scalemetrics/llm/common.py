"""What the training-data operators share: tables, word patterns, bounded Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are what stands between these white-space characters.
SPACES = r"\x20\x09-\x0D"
SPACE_RUN = f"[{SPACES}]+"

ROWS_PER_BATCH, BYTES_PER_BATCH = 256, 8 << 20
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without a filtered copy of the array: only the first and last part can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    ends = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.size(parts).cast("long") - ends


def whole_texts(df: DataFrame) -> DataFrame:
    """Bound the bytes of an Arrow batch: a worker's memory then follows the longest text, not the batch. Batches of narrow rows, which
    never reach the bound, stay as they are."""
    conf = df.sparkSession.conf
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", conf.get(limit))) > BYTES_PER_BATCH:
        conf.set(limit, f"{BYTES_PER_BATCH}b")
    return df


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few whole texts each: what a task derives from a batch stays small, whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BATCH):
            yield batch.slice(at, ROWS_PER_BATCH)


_states: dict[Hashable, object] = {}


def of_worker(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` returns, kept for as long as the Python worker lives or until another key comes: one operator's memos at a time."""
    if key not in _states:
        _states.clear()
        _states[key] = make()
    return _states[key]


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def draw(seed: str, *cols: Column) -> Column:
    """Reproducible 52-bit integer of (seed, values); nulls differ from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source as a text that is never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def range_bits(rows: int, per_range: int, most: int) -> int:
    """Bits of a range number so that a range holds about ``per_range`` of ``rows`` evenly spread rows."""
    return max(4, min(most, (max(rows, 1) // per_range).bit_length()))
