"""The stateless steps on a stream: blocks in, routed records out.

Normalising, parsing and routing look at one row at a time, so the batch
expressions run on a stream as they are. What compares rows (duplicates, splits)
stays with batch jobs over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import clean, parse
from corpusloom.operators.normalize import normalize_text, separated_blocks
from corpusloom.policy import Policy


def route_stream(blocks: DataFrame, policy: Policy) -> DataFrame:
    """Routed records of a stream (or table) of block_number and block."""
    normal = separated_blocks(blocks.select("block_number", normalize_text(F.col("block"), policy).alias("block")), "block")
    return clean.route_by_quality(parse.accepted(parse.parse_blocks(normal, policy)), policy).drop("hard", "review")


def write_stream(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now, once, a folder for each status."""
    writer = routed.writeStream.format("parquet").partitionBy("status").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
