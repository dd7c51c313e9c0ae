"""A durable message log: publish appends rows, subscribers read it as a stream.

Messages carry ids that increase in the log.  A batch is published in one write;
its ids continue after the greatest so far, so one writer publishes at a time.
Subscriptions start from the earliest message, the latest, or an id, and resume
from their checkpoint.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.operators.relational import rownum

SCHEMA = "id bigint, channel string, ts_ms bigint, payload string"


def glob_pattern(pattern: str) -> str:
    """A glob with * ? and [..] as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in ("^", "!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def messages(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def publish(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Append (channel, payload[, ts_ms]) rows; returns the last id."""
        last = self.messages().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        stamped = rows if "ts_ms" in rows.columns else rows.withColumn("ts_ms", F.lit(int(time.time() * 1000)))
        numbered = rownum(stamped, *[F.col(c) for c in order or ["ts_ms", "channel", "payload"]], name="_n")
        made = numbered.select((F.col("_n") + F.lit(last)).cast("bigint").alias("id"), "channel", F.col("ts_ms").cast("bigint").alias("ts_ms"), "payload")
        made.write.mode("append").parquet(self.path)
        return self.messages().agg(F.max("id")).first()[0] or 0

    def replay(self, channel: str | None = None, after: int = 0, pattern: str | None = None) -> DataFrame:
        """The messages after an id, of a channel or of channels that match a glob."""
        return _chosen(self.messages(), channel, after, pattern)

    def subscribe(self, channel: str | None = None, start: str | int = "earliest", pattern: str | None = None, files_per_trigger: int = 100) -> DataFrame:
        """A streaming DataFrame; it reads at most ``files_per_trigger`` files at a time."""
        after = 0 if start == "earliest" else (self.messages().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if start == "latest" else int(start))
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)
        return _chosen(stream, channel, after, pattern)

    def channels(self) -> DataFrame:
        return self.messages().groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.max("id").alias("last_id"))

    def trim(self, keep_rows: int = 200_000, keep_bytes: int = 512 << 20) -> int:
        """Keep the newest messages within both bounds, in a rewritten log; returns how many went."""
        now = self.messages()
        last = now.agg(F.max("id"), F.count(F.lit(1))).first()
        newest = Window.orderBy(F.col("id").desc())
        kept = now.where(F.col("id") > (last[0] or 0) - keep_rows).withColumn("_b", F.sum(F.octet_length("payload") + 32).over(newest)).where(F.col("_b") <= keep_bytes).drop("_b")
        first = kept.agg(F.min("id")).first()[0]
        if first is None:
            return 0
        gone = now.where(F.col("id") < first).count()
        if gone:
            fresh = f"{self.path}-{first}"
            now.where(F.col("id") >= first).write.parquet(fresh)
            self.path = fresh
        return gone


def _chosen(df: DataFrame, channel: str | None, after: int, pattern: str | None) -> DataFrame:
    out = df.where(F.col("id") > after)
    out = out.where(F.col("channel") == channel) if channel is not None else out
    return out.where(F.col("channel").rlike(glob_pattern(pattern))) if pattern is not None else out


def windowed_counts(events: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window, batch or stream; a stream drops what comes later than ``late``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = timed.withWatermark(ts, late) if events.isStreaming else timed
    return marked.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
