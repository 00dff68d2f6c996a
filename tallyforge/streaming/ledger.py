"""Structured Streaming twins: a ledger that batches are merged into, windowed totals with late data, events that ask for a refresh (STR-07 to STR-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.snapshots import upserted


def merge_into(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Each batch writes a new generation of the ledger, so that a batch that is run again gives the same
    one and readers of the last generation are not disturbed."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = newest(spark, path, before=number)
        rows = batch if last is None else last.unionByName(batch, allowMissingColumns=True)
        upserted(rows.limit(0), rows, key, order).write.mode("overwrite").parquet(f"{path}/generation={number:012d}")

    return merge


def newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The ledger's last complete generation, or that before a batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = {int(p.getName().split("=")[1]): p.toString() for p in found}
    numbers = {n: p for n, p in numbers.items() if before is None or n < before}
    return spark.read.parquet(numbers[max(numbers)]) if numbers else None


def start_ledger(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merge_into(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Totals by event-time window and key; rows later than the watermark are left out, as in any windowed stream."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))


#: Events that may follow a change, those of them that name a tool, and the tools that only read.
CHANGE_EVENTS = ["PostToolUse", "Stop", "AfterTool", "AfterAgent", "afterFileEdit", "afterShellExecution", "stop"]
TOOL_EVENTS = ["PostToolUse", "AfterTool"]
READ_ONLY_TOOLS = [
    "Read", "Grep", "Glob", "LS", "NotebookRead", "WebFetch", "WebSearch", "TodoWrite",
    "read_file", "read_many_files", "glob", "search_file_content", "list_directory", "web_fetch", "google_web_search",
    "view", "grep",
]


def refresh_due(events: DataFrame, root: str, own_tools: str) -> DataFrame:
    """STR-09: the events (value: a JSON object) after which an index of `root` must be refreshed, of a table or a stream. Tools that only
    read, tools whose name starts with own_tools, other folders and lines that are no object ask for none."""
    at = lambda path: F.get_json_object("value", path)
    tool = F.coalesce(at("$.tool_name"), at("$.toolName"), F.lit(""))
    idle = at("$.hook_event_name").isin(TOOL_EVENTS) & (tool.isin(READ_ONLY_TOOLS) | tool.startswith(own_tools))
    root = root.rstrip("/")
    roots = F.coalesce(F.from_json(at("$.workspace_roots"), "array<string>"), F.array().cast("array<string>"))
    listed = at("$.hook_event_name").isin("afterFileEdit", "afterShellExecution", "stop") & F.array_contains(roots, root)
    where = F.coalesce(F.when(at("$.cwd") != "", at("$.cwd")), F.when(listed, F.lit(root)), F.lit(""))
    inside = ((where == root) | where.startswith(root + "/")) & ~where.rlike(r"(^|/)\.\.(/|$)")
    return events.filter(F.coalesce(at("$.hook_event_name").isin(CHANGE_EVENTS) & ~idle & inside, F.lit(False)))
