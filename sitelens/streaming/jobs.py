"""Structured Streaming jobs.

Sources are files landed in the shared folder named by ``spark.checkpoint.dir``
(never a machine-local folder): the derived batch is written as one file and a
*sentinel* file with timestamps far in the future follows it, read with
``maxFilesPerTrigger=1``.  The sentinel's micro-batch moves the watermark past
every real event, so late-closing state (unanswered requests, open windows) is
emitted and the stream result equals the batch result.  Sentinel rows never
reach the output.

Each job runs with ``trigger(availableNow=True)``, checkpoints its state in the
shared folder (restartable after executor or driver loss) and writes a parquet
table, which the caller reads back as a batch DataFrame.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitelens.operators.domains import EXAMPLE_URLS, external_requests
from sitelens.session import ensure_checkpoint_dir

SENTINEL_TS = "2200-01-01 00:00:00"
PAIR_WATERMARK = "2 hours"
ROLLUP_WINDOW = "1 day"        # X2 tumbling window
ROLLUP_WATERMARK = "1 hour"
WINDOW_MS = 86_400_000
QUIET, LATE = "30 minutes", "1 hour"  # X3: a page is complete when nothing came for so long; how late evidence may be


def scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "sitelens-stream", f"{name}-{uuid.uuid4().hex[:12]}")


def land(df: DataFrame, sentinel: DataFrame, folder: str) -> str:
    """Write the data, in as many files as it has partitions, and the sentinel beside it.

    A batch takes all files that are there; the sentinel moves the watermark past them, and the batch
    that follows emits what was waiting for it.
    """
    src = os.path.join(folder, "source")
    df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(src, "part=0"))
    sentinel.write.mode("overwrite").parquet(os.path.join(src, "part=1"))
    return src


def _stream(spark: SparkSession, src: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)


def _run(query_df: DataFrame, folder: str, mode: str = "append", batch_fn=None) -> str:
    out = os.path.join(folder, "out")
    w = query_df.writeStream.option("checkpointLocation", os.path.join(folder, "checkpoint")).outputMode(mode)
    if batch_fn is None:
        w = w.format("parquet").option("path", out)
    else:
        w = w.foreachBatch(lambda b, epoch: batch_fn(b, epoch, out))
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return out


# ---------------------------------------------------------------------------
# Request / response pairing (keyed state)
# ---------------------------------------------------------------------------
PAIRS = "req_id long, k long, req_us long, resp_id long, resp_us long"
#: Events that the watermark has not passed, and requests without a response yet; times in microseconds.
PAIR_STATE = "us array<long>, id array<long>, answers array<boolean>, wait_us array<long>, wait_id array<long>"
HOUR_US = 3_600_000_000


def request_events(events: DataFrame) -> DataFrame:
    """clicks are requests, views are responses; key = the user; ts as TIMESTAMP (UTC)."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                         F.col("user_id").alias("k"), "event_type") \
        .filter(F.col("event_type").isin("click", "view"))


def pair_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests in event order, each with the first free response: a response answers the oldest request of its key
    that still waits, for an hour at most; at equal times requests come first, then smaller ids.

    An event takes its turn when the watermark has passed it, so late arrivals within the delay change nothing.
    State holds the events of the delay and the requests of the last hour.
    """
    us, ids, answers, wait_us, wait_id = map(list, state.get) if state.exists else ([], [], [], [], [])
    for batch in batches:
        us += batch["us"].tolist()
        ids += batch["event_id"].tolist()
        answers += batch["answers"].tolist()
    passed = state.getCurrentWatermarkMs() * 1000
    events = sorted(zip(us, answers, ids))
    ready = [e for e in events if e[0] <= passed]
    waiting = deque(zip(wait_us, wait_id))
    out = []

    def expire(now: int) -> None:
        while waiting and waiting[0][0] < now - HOUR_US:
            at, request = waiting.popleft()
            out.append((request, key[0], at, None, None))

    for at, is_answer, event in ready:
        expire(at)
        if not is_answer:
            waiting.append((at, event))
        elif waiting:
            asked, request = waiting.popleft()
            out.append((request, key[0], asked, event, at))
    expire(passed)
    left = events[len(ready):]
    if left or waiting:
        state.update(tuple(list(c) for c in ([e[0] for e in left], [e[2] for e in left], [e[1] for e in left], [w[0] for w in waiting], [w[1] for w in waiting])))
        due = min([e[0] for e in left[:1]] + [w[0] + HOUR_US for w in list(waiting)[:1]])
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["req_id", "k", "req_us", "resp_id", "resp_us"]).astype({"resp_id": "Int64", "resp_us": "Int64"})


def pair_stream(events: DataFrame) -> DataFrame:
    """One row per request of a stream of ``request_events``."""
    e = events.withWatermark("ts", PAIR_WATERMARK).select("k", "event_id", "ts", F.unix_micros("ts").alias("us"), (F.col("event_type") == "view").alias("answers"))
    return e.groupBy("k").applyInPandasWithState(pair_events, PAIRS, PAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_pairing(spark: SparkSession, events: DataFrame) -> DataFrame:
    folder = scratch(spark, "pairing")
    ev = request_events(events)
    sent = spark.createDataFrame([(-1, "click"), (-2, "view")], "event_id long, event_type string") \
        .select("event_id", F.to_timestamp(F.lit(SENTINEL_TS)).alias("ts"), F.lit(-1).cast("long").alias("k"),
                "event_type")
    src = land(ev, sent, folder)
    out = _run(pair_stream(_stream(spark, src, ev.schema)), folder)
    return spark.read.parquet(out).filter(F.col("req_id") >= 0)


# ---------------------------------------------------------------------------
# Windowed external-domain rollup (D1 over tumbling windows)
# ---------------------------------------------------------------------------
ROLLUP = "site_url string, domain string, window_start_us long, request_count long, resource_types string, example_urls string, first_seq long"
ROLLUP_STATE = "n long, types array<string>, seqs array<long>, urls array<string>"
#: Sites and domains of a window share a state row in shards: one call for a shard, not one for each of them.
ROLLUP_SHARDS, ROLLUP_ROWS = 64, 50_000
SHARD_STATE = "counts binary, types binary, examples binary"


def request_feed(events: DataFrame) -> DataFrame:
    """Every event as a request of its user's site: sign-ups go to the site's own API, the rest to third parties."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    own = F.concat(F.lit("https://api.shop"), user, F.lit(".example.com/v1/"), F.col("event_id").cast("string"))
    other = F.concat(F.lit("https://cdn"), (F.col("user_id") % 7).cast("string"), F.lit(".example.io/"), kind, F.lit("/"), F.col("event_id").cast("string"))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://www.shop"), user, F.lit(".example.com/")).alias("site_url"),
                         F.when(kind == "signup", own).otherwise(other).alias("url"), kind.alias("resource_type"), F.col("event_id").alias("seq"))


def rollup_window(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count, types and the first three URLs of one site, domain and window; emitted when the watermark closes it.

    State is bounded: a count, the types, and ``EXAMPLE_URLS`` URLs, whatever the number of requests.
    """
    site, domain, start = key
    n, types, seqs, urls = state.get if state.exists else (0, [], [], [])
    kept, first = set(types), list(zip(seqs, urls))
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(site, domain, start, n, ",".join(sorted(kept)), "\n".join(u for _, u in first), first[0][0])],
                           columns=["site_url", "domain", "window_start_us", "request_count", "resource_types", "example_urls", "first_seq"])
        return
    for batch in batches:
        n += len(batch)
        kept.update(t for t in batch["resource_type"].unique() if t)
        top = batch.nsmallest(EXAMPLE_URLS, "seq")
        first = sorted(first + list(zip(top["seq"].tolist(), top["url"].tolist())))[:EXAMPLE_URLS]
    state.update((n, sorted(kept), [q for q, _ in first], [u for _, u in first]))
    state.setTimeoutTimestamp(max(int(start) // 1000 + WINDOW_MS, state.getCurrentWatermarkMs() + 1))


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def rollup_shard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What ``rollup_window`` gives, for every site and domain of one shard and window at a time.

    State is bounded: per site and domain a count, the types, and ``EXAMPLE_URLS`` URLs, whatever the number of requests.
    """
    who, start = ["site_url", "domain"], int(key[1])
    held = [pa.ipc.open_stream(bytes(b)).read_pandas() for b in state.get] if state.exists else None
    if state.hasTimedOut:
        state.remove()
        counts, types, examples = held
        out = counts.rename(columns={"n": "request_count"}).set_index(who)
        by_type = types.sort_values("resource_type").groupby(who, dropna=False)["resource_type"].agg(",".join)
        first = examples.sort_values("seq", kind="stable").groupby(who, dropna=False).agg(example_urls=("url", "\n".join), first_seq=("seq", "first"))
        out = out.join(by_type.rename("resource_types")).join(first).reset_index()
        yield out.assign(window_start_us=start, resource_types=out["resource_types"].fillna(""))[["site_url", "domain", "window_start_us", "request_count", "resource_types", "example_urls", "first_seq"]]
        return
    def fold(rows: list[pd.DataFrame]) -> list[pd.DataFrame]:
        batch = pd.concat(rows)
        new = [batch.groupby(who, as_index=False, dropna=False).size().rename(columns={"size": "n"}),
               batch.loc[batch["resource_type"].fillna("") != "", [*who, "resource_type"]], batch[[*who, "seq", "url"]]]
        counts, types, examples = new if held is None else [pd.concat(x) for x in zip(held, new)]
        return [counts.groupby(who, as_index=False, dropna=False)["n"].sum(), types.drop_duplicates(),
                examples.sort_values(["seq", "url"]).groupby(who, dropna=False).head(EXAMPLE_URLS)]

    rows: list[pd.DataFrame] = []
    for batch in batches:
        rows.append(batch)
        if sum(map(len, rows)) >= ROLLUP_ROWS:
            held, rows = fold(rows), []
    if rows:
        held = fold(rows)
    state.update(tuple(map(_packed, held)))
    state.setTimeoutTimestamp(max(start // 1000 + WINDOW_MS, state.getCurrentWatermarkMs() + 1))


def rollup_stream(requests: DataFrame) -> DataFrame:
    """``external_rollup`` of every window and site of a stream of requests (ts, site_url, url, resource_type, seq)."""
    start = F.unix_micros(F.window("ts", ROLLUP_WINDOW)["start"])
    r = external_requests(requests.withWatermark("ts", ROLLUP_WATERMARK).withColumn("window_start_us", start))
    r = r.withColumn("shard", F.pmod(F.xxhash64("site_url", "domain"), F.lit(ROLLUP_SHARDS)))
    return r.groupBy("shard", "window_start_us").applyInPandasWithState(rollup_shard, ROLLUP, SHARD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_domain_windows(spark: SparkSession, events: DataFrame) -> DataFrame:
    folder = scratch(spark, "domains")
    ev = request_feed(events)
    sent = spark.createDataFrame([(-1, "https://sentinel.invalid/", "https://other.invalid/", "sentinel")], "seq long, site_url string, url string, resource_type string") \
        .select(F.to_timestamp(F.lit(SENTINEL_TS)).alias("ts"), "site_url", "url", "resource_type", "seq")
    src = land(ev, sent, folder)
    out = _run(rollup_stream(_stream(spark, src, ev.schema)), folder)
    return spark.read.parquet(out).filter(F.col("first_seq") >= 0)


# ---------------------------------------------------------------------------
# Streaming detection over every evidence source (session windows, foreachBatch)
# ---------------------------------------------------------------------------
EVIDENCE = "page_id long, kind string, payload string, captured_at timestamp"


def evidence_events(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of every source as one feed of evidence, with the time of their first capture.

    A page's pieces arrive minutes apart: capture times come from the page id and the source.
    """
    out = None
    for lag, (kind, rows) in enumerate(sources.items()):
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60 + F.lit(lag * 120))
        one = rows.select("page_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in rows.columns if c != "page_id"])).alias("payload"), at.alias("captured_at"))
        out = one if out is None else out.unionByName(one)
    return out


def captured_twice(s: DataFrame) -> DataFrame:
    """Every capture and its repeat five minutes later; made as the stream is read, so that no whole copy is landed."""
    return s.withColumn("captured_at", F.explode(F.array("captured_at", F.col("captured_at") + F.expr("INTERVAL 5 MINUTES"))))


def gathered(s: DataFrame) -> DataFrame:
    """(page_id, evidence): everything captured of a page, repeats dropped, once no more came for ``QUIET``."""
    g = s.withWatermark("captured_at", LATE).groupBy("page_id", F.session_window("captured_at", QUIET).alias("w"))
    return g.agg(F.collect_set(F.struct("kind", "payload")).alias("evidence")).select("page_id", "evidence", F.col("w.start").alias("captured_at"))


def written_evidence(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """(page_id, payload, kind) of a micro-batch of gathered pages, from files by kind.

    The state is walked once for all sources, and Spark knows the size of each.  Read from the batch itself, every source
    would walk the state again (a cache serves the first one only), and the batch that follows the last file has the
    size of its empty input: all its evidence would be broadcast through the driver.
    """
    rows = batch.filter(F.col("page_id") >= 0).select("page_id", F.explode("evidence").alias("e"))
    rows = rows.select("page_id", "e.payload", "e.kind")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def evidence_of(evidence: DataFrame, kind: str, schema) -> DataFrame:
    """The rows of one source of ``written_evidence``, with the columns they had."""
    fields = [f for f in schema.fields if f.name != "page_id"]
    rows = evidence.filter(F.col("kind") == kind)
    return rows.select("page_id", F.from_json("payload", T.StructType(fields)).alias("r")).select("page_id", "r.*")


def stream_detect(spark: SparkSession, sources: dict[str, DataFrame], detect_batch) -> DataFrame:
    """``detect_batch({kind: rows})`` runs per micro-batch on the pages whose evidence is complete, against the static rules."""
    folder = scratch(spark, "detect")
    ev = evidence_events(sources)
    sent = spark.createDataFrame([(-1, "sentinel", "{}")], "page_id long, kind string, payload string") \
        .select("page_id", "kind", "payload", F.to_timestamp(F.lit(SENTINEL_TS)).alias("captured_at"))
    src = land(ev, sent, folder)
    s = gathered(captured_twice(_stream(spark, src, ev.schema)))

    def per_batch(batch: DataFrame, epoch: int, out: str) -> None:
        # idempotent per epoch: a replayed batch overwrites its own evidence and its own partition
        evidence = written_evidence(spark, batch, os.path.join(folder, "evidence", f"epoch={epoch}"))
        rows = {kind: evidence_of(evidence, kind, df.schema) for kind, df in sources.items()}
        detect_batch(rows).withColumn("epoch", F.lit(epoch)).write.mode("overwrite") \
            .parquet(os.path.join(out, f"epoch={epoch}"))

    out = _run(s, folder, batch_fn=per_batch)
    return spark.read.option("basePath", out).parquet(out).drop("epoch")
