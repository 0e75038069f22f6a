"""Streaming state functions on small inputs, in and out of order; bundles analysed once."""
import random

import pandas as pd
from pyspark.sql import functions as F

from sitelens.operators import js_routes as J
from sitelens.streaming import jobs as X

HOUR = X.HOUR_US


class State:
    """What the engine hands to a stateful function: its value, the watermark and a timer."""

    def __init__(self):
        self.value, self.watermark, self.timer, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timer = ms


def pair(batches):
    """Rows over several calls; each batch is (watermark in us, [(us, id, answers)])."""
    state, rows = State(), []
    for watermark, events in [*batches, (10**15, [])]:
        state.watermark = watermark // 1000
        frames = [pd.DataFrame(events, columns=["us", "event_id", "answers"])] if events else []
        for out in X.pair_events((7,), iter(frames), state):
            rows += [tuple(None if pd.isna(v) else int(v) for v in r) for r in out.itertuples(index=False)]
    assert state.value is None
    return sorted(rows)


def test_each_request_has_one_response_whatever_the_batches():
    events = [(0, 1, False), (10, 2, False), (20, 3, True), (20, 4, False), (30, 5, True), (5 * HOUR, 6, True), (5 * HOUR, 7, False), (5 * HOUR + 1, 8, False), (6 * HOUR, 9, True),
              (6 * HOUR + 1, 10, True), (9 * HOUR, 11, False)]
    want = [(1, 7, 0, 3, 20), (2, 7, 10, 5, 30), (4, 7, 20, None, None), (7, 7, 5 * HOUR, 6, 5 * HOUR), (8, 7, 5 * HOUR + 1, 9, 6 * HOUR), (11, 7, 9 * HOUR, None, None)]
    assert pair([(0, events)]) == want
    assert pair([(0, events[::-1])]) == want
    assert pair([(0, events[6:]), (0, events[:6])]) == want
    assert pair([(0, [e]) for e in events]) == want
    assert pair([(25_000, []), *[(max(0, (e[0] - 2 * HOUR)), [e]) for e in events]]) == want


def test_rollup_state_is_bounded_and_the_first_urls_win():
    state, start = State(), 0
    for a in range(0, 90, 30):
        frame = pd.DataFrame({"resource_type": ["x", "y", None] * 10, "seq": range(100 - a, 70 - a, -1), "url": [f"u{q}" for q in range(100 - a, 70 - a, -1)]})
        assert list(X.rollup_window(("s", "d", start), iter([frame]), state)) == []
        assert len(state.value[2]) == 3
    state.hasTimedOut = True
    out = next(X.rollup_window(("s", "d", start), iter([]), state))
    assert out.iloc[0].tolist() == ["s", "d", 0, 90, "x,y", "u11\nu12\nu13", 11] and state.value is None


def test_a_rollup_shard_gives_what_its_windows_give(monkeypatch):
    monkeypatch.setattr(X, "ROLLUP_ROWS", 40)
    rows = pd.DataFrame({"site_url": [f"s{i % 3}" for i in range(300)], "domain": [f"d{i % 7}" for i in range(300)],
                         "resource_type": [("x", "y", None)[i % 11 % 3] if i % 21 else None for i in range(300)], "seq": [(i * 37) % 301 for i in range(300)]})
    rows["url"] = "u" + rows["seq"].astype(str)
    shard, want = State(), []
    for a in range(0, 300, 100):
        assert list(X.rollup_shard((5, 0), iter([rows[a:a + 30], rows[a + 30:a + 100]]), shard)) == []
    for (site, domain), some in rows.groupby(["site_url", "domain"]):
        one = State()
        list(X.rollup_window((site, domain, 0), iter([some]), one))
        one.hasTimedOut = True
        want.append(next(X.rollup_window((site, domain, 0), iter([]), one)))
    shard.hasTimedOut = True
    got = next(X.rollup_shard((5, 0), iter([]), shard))
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, pd.concat(want).values.tolist())) and len(got) == 21 and shard.value is None


def test_sites_of_a_window_share_calls(spark, tmp_path):
    requests = spark.readStream.schema("ts timestamp, site_url string, url string, resource_type string, seq long").parquet(str(tmp_path))
    assert X.ROLLUP_SHARDS < 100 and "shard" in X.rollup_stream(requests)._jdf.queryExecution().analyzed().toString()


def test_bundles_are_analysed_once_a_body(spark):
    body = 'fetch("/api/users/list"); x = "/api/items/1"'
    scripts = spark.createDataFrame([(i, f"http://h/{i % 3}.js", body if i < 50 else None if i == 50 else 'y = "/v1/other"') for i in range(53)], "page_id long, js_url string, body string")
    once = J.routes_by_digest(scripts, "body")
    assert sorted(r.route for r in once.collect()) == ["/api/items/1", "/api/users/list", "/v1/other"]
    got = {(r.page_id, r.route) for r in J.bundle_routes(scripts).collect()}
    assert got == {(i, p) for i in range(50) for p in ("/api/users/list", "/api/items/1")} | {(i, "/v1/other") for i in (51, 52)}


def test_evidence_of_complete_pages_is_of_known_size(spark):
    """No source is taken for small and broadcast, nor read from the state again; each page comes once and whole."""
    html = {i: random.Random(i).randbytes(4000).hex() for i in range(200)}
    sources = {"page": spark.createDataFrame([(i, h, None) for i, h in html.items()], "page_id long, html string, url string"),
               "names": spark.createDataFrame([(i, n) for i in range(0, 200, 2) for n in ("b", "a", "a")], "page_id long, name string"),
               "none": spark.createDataFrame([], "page_id long, x int")}
    seen = []

    def detect(rows):
        plans = {kind: df._jdf.queryExecution().optimizedPlan() for kind, df in rows.items()}
        seen.append((plans["page"].stats().sizeInBytes(), any("RDD" in p.toString() for p in plans.values())))
        names = rows["names"].groupBy("page_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
        return rows["page"].join(names, "page_id", "left").join(rows["none"], "page_id", "left")

    got = {r.page_id: (r.html, r.url, r.names, r.x) for r in X.stream_detect(spark, sources, detect).collect()}
    assert got == {i: (h, None, None if i % 2 else ["a", "b"], None) for i, h in html.items()}
    assert max(size for size, _ in seen) > 500_000 and not any(again for _, again in seen)
