"""Structured Streaming jobs built from the batch transforms.

Each job takes its checkpoint folder from the caller; on a cluster it has to be
shared storage.  All of them run to the end of the input with
``availableNow`` or without end with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.operators import traces as tr
from corpuskit.sources.index import index_exists, read_index, write_index


# Collections of one batch up to this number are named in the filter on the index.
MOST_PRUNED = 10_000


def _start(writer, trigger: dict | None) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_ingest(
    documents: DataFrame, transform: Callable[[DataFrame], DataFrame], index_path: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """New documents through the batch ``transform`` (clean, chunk, embed) into the index.

    ``transform`` yields index rows with collection and chunk_id.  Ids are
    deterministic and a batch inserts only unknown ones, so a batch replayed
    after a failure adds nothing.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, ["collection", "chunk_id"]
        rows = transform(batch).dropDuplicates(keys)
        if index_exists(spark, index_path):
            known = read_index(spark, index_path)
            # Only the partitions that this batch writes to.
            names = [r[0] for r in rows.select("collection").distinct().limit(MOST_PRUNED + 1).collect()]
            if len(names) <= MOST_PRUNED:
                known = known.filter(F.col("collection").isin(names))
            rows = rows.join(known.select(*keys), keys, "left_anti")
        write_index(rows, index_path)

    return _start(
        documents.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint), trigger)


# Groups of keys that share one state.
REPEAT_GROUPS = 1024


def suppress_repeats(
    stream: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "1 hour", idle: str | None = None,
    groups: int = REPEAT_GROUPS,
) -> DataFrame:
    """Pass a row of a key and hold back those less than ``ttl`` after the last one passed.

    The state is one timestamp per key, kept for good unless ``idle`` is given:
    then rows later than that by event time are dropped, as with any watermark,
    and a key without rows for so long is forgotten.  Otherwise no row is dropped
    for being late; one that lies before the last passed row counts as its repeat.
    Keys are dealt by hash to ``groups`` states, so that a call of the function
    serves many of them; the number is fixed with the checkpoint, and a batch
    writes the states of the groups it touches.
    """
    gap = int(pd.Timedelta(ttl).total_seconds() * 1e6)
    rest = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = stream.columns

    def choose(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # Of each key the last row passed, and the time after which it is forgotten.
        names, lasts, untils = state.get if state.exists else ([], [], [])
        known = {name: (last, until) for name, last, until in zip(names, lasts, untils)}
        watermark = 0 if rest is None else state.getCurrentWatermarkMs()
        out, asked = None, set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            codes, fresh = pd.factorize(rows["_repeat_key"])
            values = rows[ts].astype("datetime64[us]").astype("int64").to_numpy()
            order, kept, before, last = np.lexsort((values, codes)), [], None, None
            for at, code, value in zip(order.tolist(), codes[order].tolist(), values[order].tolist()):
                if code != before:
                    before, name = code, fresh[code]
                    last = known[name][0] if name in known else None
                if last is None or value - last >= gap:
                    last = value
                    kept.append(at)
                    known[name] = (last, 0)
            asked = set(fresh)
            out = rows.loc[kept, columns]
        if rest is not None:
            for name in asked:
                last = known[name][0]
                known[name] = (last, max(last // 1000 + rest, watermark + 1))
            known = {name: one for name, one in known.items() if name in asked or one[1] >= watermark}
        if known:
            state.update((list(known), [last for last, _ in known.values()], [until for _, until in known.values()]))
            if rest is not None:
                state.setTimeoutTimestamp(max(min(until for _, until in known.values()), watermark + 1))
        else:
            state.remove()
        if out is not None:
            yield out

    rows = stream.filter(F.col(ts).isNotNull())
    if idle is not None:
        rows = rows.withWatermark(ts, idle)
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = rows.withColumns({
        "_repeat_key": name, "_repeat_group": F.pmod(F.xxhash64(name), F.lit(groups)).cast("int")})
    return rows.groupBy("_repeat_group").applyInPandasWithState(
        choose, stream.schema, "names array<string>, lasts array<long>, untils array<long>", "append",
        "NoTimeout" if idle is None else "EventTimeTimeout")


def trace_windows(stream: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Windowed latency and errors; rows later than ``delay`` are dropped."""
    return tr.windows(stream.withWatermark("ts", delay), width)


def write_rows(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows to Parquet, exactly once."""
    return _start(
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint), trigger)


# Batches after which the change log of statuses is merged.
MERGE_EVERY = 20


def _finished(spark, path: str, name: str) -> list[int]:
    """Numbers n of the folders ``name``=n below the path that were written to their end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [f.getPath() for f in files.listStatus(where)]
    done = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{name}="))


def _drop(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each report the row of the newest batch, pre-aggregated map-side."""
    newest = rows.groupBy("report_id").agg(F.max(F.struct("number", "status", "ts", "seq")).alias("s"))
    return newest.select("report_id", "s.*")


def _log(spark, path: str, last: int | None = None) -> DataFrame | None:
    """The newest merged folder (up to batch ``last``) and the batches after it; None if there is nothing."""
    merged = [n for n in _finished(spark, f"{path}/merged", "upto") if last is None or n <= last]
    since = merged[-1] if merged else -1
    tail = [n for n in _finished(spark, f"{path}/tail", "batch") if n > since and (last is None or n <= last)]
    folders = [f"{path}/merged/upto={since}"] * bool(merged) + [f"{path}/tail/batch={n}" for n in tail]
    return spark.read.parquet(*folders).select(
        "report_id", "number", "status", "ts", "seq") if folders else None


def merge_status(spark, path: str, upto: int) -> None:
    """One folder with the newest row of every report up to a batch, in place of those before it.

    The folders it replaces go only when it is complete, so that a merge that was
    broken off, or is repeated, loses nothing.
    """
    if upto not in _finished(spark, f"{path}/merged", "upto"):
        rows = _log(spark, path, upto)
        if rows is None:
            return
        _newest(rows).write.mode("overwrite").parquet(f"{path}/merged/upto={upto}")
    for n in _finished(spark, f"{path}/tail", "batch"):
        if n <= upto:
            _drop(spark, f"{path}/tail/batch={n}")
    for n in _finished(spark, f"{path}/merged", "upto"):
        if n < upto:
            _drop(spark, f"{path}/merged/upto={n}")


def status_table(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Latest status per report.  State holds one row per report; every batch
    writes the reports it changed below ``path`` as ``tail/batch=<n>``, and a
    replayed batch overwrites its own folder.  After every ``merge_every`` batches
    the log is merged, so a reader meets at most one row per report and the
    changes of so many batches.  What a batch writes again after its merge is not
    read, and goes with the next merge."""
    latest = events.groupBy("report_id").agg(F.max(F.struct("ts", "seq", "status")).alias("s"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(
            "report_id", F.lit(batch_id).cast("long").alias("number"), F.col("s.status").alias("status"),
            F.col("s.ts").alias("ts"), F.col("s.seq").alias("seq"),
        ).write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            merge_status(spark, path, batch_id)

    return _start(
        latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def read_status(spark, path: str) -> DataFrame:
    """The current table: of each report the row of the newest batch."""
    rows = _log(spark, path)
    if rows is None:
        return spark.createDataFrame([], "report_id long, status string, ts timestamp")
    return _newest(rows).select("report_id", "status", "ts")
