import concurrent.futures
import datetime
import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention
from tidemark.operators.registry import Agent, Conflict, Missing, Registry
from tidemark.operators.retention import delete_before
from tidemark.sources import files as files_module
from tidemark.sources import scrape, store
from tidemark.streaming import ingest


def test_life_of_an_agent(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "log"))
    r.seed(), r.seed()
    assert [a.id for a in r.agents().collect()] == ["agent-1"]
    r.add(Agent("b", "h", 1))
    with pytest.raises(Conflict):
        r.add(Agent("b", "h", 1))
    made = r.get("b").created_at
    r.scraped("b", datetime.datetime(2024, 1, 1), "success")
    r.update(Agent("b", "h2", 2, enabled=False))
    b = r.get("b")
    assert (b.host, b.enabled, b.created_at, b.last_scrape_status) == ("h2", False, made, "success")
    with pytest.raises(Missing):
        r.update(Agent("none", "h", 1))
    with pytest.raises(Conflict):
        r.rename("b", "agent-1")
    r.rename("b", "c")
    assert r.get("b") is None and r.get("c").last_scrape_status == "success" and r.get("c").created_at == made
    r.patch("c", timeout_seconds=9, path=None)
    assert (r.get("c").timeout_seconds, r.get("c").path) == (9, "/metrics")
    r.enable("c", True), r.delete("c")
    assert r.get("c").enabled is False
    r.delete("c", hard=True)
    r.compact()
    assert r.get("c") is None and r.log().count() == 1
    with pytest.raises(Missing):
        r.delete("c")


def test_writers_at_once(spark, tmp_path):
    """Of many that add one id one succeeds; those that add others all do; a compaction beside them loses none."""
    r = Registry(spark, str(tmp_path / "log"))
    r.seed()

    def one(k):
        try:
            Registry(spark, str(tmp_path / "log")).add(Agent("same" if k % 2 else f"own-{k}", f"h{k}", 1))
            return "added"
        except Conflict:
            return "conflict"

    with concurrent.futures.ThreadPoolExecutor(8) as pool:
        told = [pool.submit(one, k) for k in range(12)]
        time.sleep(1)
        r.compact()
        told = [t.result() for t in told]
    assert told[::2] == ["added"] * 6 and sorted(told[1::2]) == ["added"] + ["conflict"] * 5
    assert {a.id for a in r.agents().collect()} == {"agent-1", "same", *(f"own-{k}" for k in range(0, 12, 2))}
    assert [n for n in r.files.names(r.path) if n.startswith("_")] == []
    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: r.patch("same", **{f: k for f in (("port",) if k % 2 else ("timeout_seconds",))}), (7, 8)))
    assert (r.get("same").port, r.get("same").timeout_seconds) == (7, 8)  # no change overwrites the other
    r.rename("same", "other")
    r.compact(), r.compact()
    assert r.log().count() == 8 and {x["id"] for x in scrape.registered(str(tmp_path / "log"))} == {a.id for a in r.agents().collect()}
    r.delete("other", hard=True)
    assert r.get("other") is None and r.get("same") is None


METRIC = "id long, name string, value double, timestamp timestamp, agent_id string, tags map<string,string>"


def stored(spark, path):
    return sorted(r.id for r in store.read_metrics(spark, path).collect())


def test_retention(spark, tmp_path):
    rows = [(i, "a", 1.0, datetime.datetime(2024, 1, d, h), "x", {}) for i, (d, h) in enumerate([(1, 0), (2, 0), (2, 12), (3, 0)])]
    path = str(tmp_path / "m")
    store.write_metrics(spark.createDataFrame(rows, METRIC), path)
    assert delete_before(spark, path, datetime.datetime(2024, 1, 2, 12)) == ["2024-01-01"]
    assert stored(spark, path) == [2, 3]
    assert delete_before(spark, path, datetime.datetime(2024, 1, 2, 12)) == [] and stored(spark, path) == [2, 3]


def test_retention_beside_appends(spark, tmp_path, monkeypatch):
    """Rows that arrive between the look at the day's files and their replacement stay, and files without old rows aren't touched."""
    path, at = str(tmp_path / "m"), lambda h: datetime.datetime(2024, 1, 2, h)
    for i, h in enumerate((0, 12, 18)):
        store.write_metrics(spark.createDataFrame([(i, "a", 1.0, at(h), "x", {}), (10 + i, "a", 1.0, at(h + 1), "x", {})], METRIC), path)
    files = lambda: {p for p in (tmp_path / "m").rglob("*.parquet")}
    before = files()
    real = retention._replaced

    def late(*args):  # noqa: ANN002
        store.write_metrics(spark.createDataFrame([(99, "a", 1.0, at(1), "x", {}), (98, "a", 1.0, at(20), "x", {})], METRIC), path)
        real(*args)

    monkeypatch.setattr(retention, "_replaced", late)
    delete_before(spark, path, at(1))
    assert stored(spark, path) == [1, 2, 10, 11, 12, 98, 99]
    assert len(before & files()) == len(before) - 1
    monkeypatch.undo()
    n = retention.compact_day(spark, path, "2024-01-02")
    assert n > 1 and len(files()) < n and stored(spark, path) == [1, 2, 10, 11, 12, 98, 99]


@pytest.mark.parametrize("step", ["plan", "delete", "rename"])
def test_retention_after_a_crash(spark, tmp_path, monkeypatch, step):
    path, at = str(tmp_path / "m"), lambda h: datetime.datetime(2024, 1, 2, h)
    for i, h in enumerate((0, 1)):
        store.write_metrics(spark.createDataFrame([(i, "a", 1.0, at(h), "x", {}), (10 + i, "a", 1.0, at(h + 12), "x", {})], METRIC), path)

    def broken(*args):
        raise KeyboardInterrupt

    target = {"plan": "write", "delete": "delete_uri", "rename": "rename"}[step]
    monkeypatch.setattr(files_module.Files, target, broken)
    with pytest.raises(KeyboardInterrupt):
        delete_before(spark, path, at(6))
    monkeypatch.undo()
    delete_before(spark, path, at(6))
    assert stored(spark, path) == [10, 11] and not [p for p in (tmp_path / "m").iterdir() if p.name.startswith("_replace")]


def test_due_in_another_zone(spark, tmp_path, monkeypatch):
    from tidemark.api import Service

    monkeypatch.setenv("TZ", "America/New_York"), time.tzset()
    try:
        s = Service(spark, str(tmp_path))
        s.create(Agent("x", "127.0.0.1", 9))
        now = datetime.datetime.now(datetime.UTC)
        spark.createDataFrame([("x", now - datetime.timedelta(hours=1), now - datetime.timedelta(hours=1), 1, "success", None, now.date(), "own")], s.runs().schema).write.partitionBy("date", "round").parquet(s.runs_path)
        s.scrape_due()
        assert s.runs().count() == 2
        s.scrape_due(now)
        assert s.runs().count() == 2
    finally:
        monkeypatch.undo(), time.tzset()


def bodies_of(spark, agent, n=2):
    return spark.createDataFrame([(agent, f"up {k} {1700000000000 + k * 86400000}\nup {k} {1700000000000 + k * 86400000}") for k in range(n)], "agent_id string, body string").selectExpr("agent_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,monotonically_increasing_id()) as scraped_at", "body", "cast(null as string) as error")


@pytest.mark.parametrize("step", ["metrics", "runs", "rounds"])
def test_a_round_that_breaks_off_is_stored_once(spark, tmp_path, monkeypatch, step):
    """Wherever a round stops, its replay leaves each sample and run once; equal lines of a body are samples of their own."""
    m, r = str(tmp_path / "m"), str(tmp_path / "runs")
    df = bodies_of(spark, "A")
    df.write.parquet(str(tmp_path / "bodies"))
    df = spark.read.parquet(str(tmp_path / "bodies"))
    ingest.store_batch(df, m, r, "other", 3)
    calls = []

    def broken(rows, path, *by):
        calls.append(path)
        store.replaced(rows, path, *by)
        if len(calls) == {"metrics": 1, "runs": 2, "rounds": 3}[step]:
            raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "replaced", broken), monkeypatch.setattr(ingest, "write_metrics", lambda rows, path, name: broken(rows.withColumn("date", F.to_date("timestamp")).withColumn("round", F.lit(name)), path))
    with pytest.raises(KeyboardInterrupt):
        ingest.store_batch(df, m, r, "mine", 0)
    monkeypatch.undo()
    figures = ingest.store_batch(df.repartition(3), m, r, "mine", 0)
    assert (figures["samples"], figures["agents"], figures["failed"]) == (4, 2, 0)
    got = store.read_metrics(spark, m)
    assert got.count() == 8 and got.select("id", "round").distinct().count() == 8 and got.select("id").distinct().count() == 4
    log = spark.read.parquet(r)
    assert log.count() == 4 and {x.n_samples for x in log.collect()} == {2} and ingest.rounds(spark, r).count() == 2


def test_two_streams_and_a_new_checkpoint(spark, tmp_path):
    """Batches of the same number from two streams, and from one whose checkpoint is new, all arrive."""
    m, r = str(tmp_path / "m"), str(tmp_path / "runs")
    schema = bodies_of(spark, "A").schema
    for agent, cp in (("A", "cp1"), ("B", "cp2")):
        bodies_of(spark, agent).write.parquet(str(tmp_path / agent))
        for _ in range(2):  # the second time there is nothing new
            ingest.start(spark.readStream.schema(schema).parquet(str(tmp_path / agent)), m, r, str(tmp_path / cp), None).awaitTermination()
    assert {(x.agent_id, x["count"]) for x in store.read_metrics(spark, m).groupBy("agent_id").count().collect()} == {("A", 4), ("B", 4)}
    ingest.start(spark.readStream.schema(schema).parquet(str(tmp_path / "A")), m, r, str(tmp_path / "cp3"), None).awaitTermination()
    assert store.read_metrics(spark, m).count() == 12 and spark.read.parquet(r).count() == 6


def test_rounds_without_samples(spark, tmp_path):
    df = spark.createDataFrame([("A", "", "timed out"), ("B", "# nothing\n", None)], "agent_id string, body string, error string").selectExpr("agent_id", "timestamp'2024-01-01 00:00:00' as scraped_at", "body", "error")
    assert {k: v for k, v in ingest.store_batch(df, str(tmp_path / "m"), str(tmp_path / "r"), "s", 0).items() if k != "ms"} == {"samples": 0, "agents": 2, "failed": 1}
    assert {(x.agent_id, x.status) for x in spark.read.parquet(str(tmp_path / "r")).collect()} == {("A", "failed: timed out"), ("B", "empty")}
    assert {k: v for k, v in ingest.store_batch(df.limit(0), str(tmp_path / "m"), str(tmp_path / "r"), "s", 1).items() if k != "ms"} == {"samples": 0, "agents": 0, "failed": 0}


@pytest.fixture
def slow():
    """A server whose agents under /slow never answer in time."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/slow":
                time.sleep(4)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"up 1\n")

        def log_message(self, *a):
            pass

    class Quiet(http.server.ThreadingHTTPServer):
        request_queue_size = 200

        def handle_error(self, *a):
            pass

    server = Quiet(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1]
    server.shutdown()


def test_slow_agents_hold_one_permit_each(spark, slow):
    """50 agents of which 10 time out after a second: about one timeout with ten permits, whatever their order."""
    agents = [{"id": str(k), "host": "127.0.0.1", "port": slow, "path": "/slow" if k % 10 in (0, 1) and k < 50 else "/", "timeout_seconds": 1} for k in range(50)]
    began = time.time()
    rows = list(scrape.fetched(agents, 10))
    assert time.time() - began < 2.8 and sum(r[3] is not None for r in rows) == 10 == sum(a["path"] == "/slow" for a in agents) and len(rows) == 50
    groups = scrape.dealt(agents, 25)
    assert [g.permits for g in groups] == [9, 8, 8] and sorted(a["id"] for g in groups for a in g.agents) == sorted(a["id"] for a in agents)


def test_stream_source_replays_bodies(spark, tmp_path, exposed):
    """A batch that is planned and read again has the same agents and bodies, until it is committed."""
    r = Registry(spark, str(tmp_path / "log"))
    r.add(Agent("a", "127.0.0.1", exposed)), r.add(Agent("b", "127.0.0.1", exposed, path="/x")), r.add(Agent("c", "127.0.0.1", exposed)), r.add(Agent("d", "127.0.0.1", exposed, enabled=False))
    (tmp_path / "stopped").mkdir()
    (tmp_path / "stopped" / b"c".hex()).touch()
    options = {"registry": str(tmp_path / "log"), "kept": str(tmp_path / "kept"), "stopped": str(tmp_path / "stopped")}
    reader = scrape._StreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [sorted(reader.read(p), key=str) for p in reader.partitions(start, end)]
    r.add(Agent("late", "127.0.0.1", exposed))
    assert [sorted(reader.read(p), key=str) for p in scrape._StreamReader(options).partitions(start, end)] == first
    assert [(x[0], x[3] is None) for x in first[0]] == [("a", True), ("b", False)]
    time.sleep(0.01)
    later = reader.latestOffset()
    reader.commit(end)
    assert not list((tmp_path / "kept").iterdir())
    assert [x["id"] for p in reader.partitions(end, later) for x in p.agents] == []  # no interval has passed
    assert [x["id"] for p in reader.partitions({"at": 0}, {"at": later["at"] + 1}) for x in p.agents] == ["a", "b", "late"]
    assert scrape.due({"id": "x", "scrape_interval_seconds": 15}, 1_000_000, 1_015_000) and sum(scrape.due({"id": "x", "scrape_interval_seconds": 15}, t, t + 1000) for t in range(1_000_000, 1_060_000, 1000)) == 4


def test_worker_state_follows_the_log(spark, tmp_path):
    """Batches in any cut, one of them given twice, leave what an aggregate over the log says; an agent without runs turns stale."""
    from tidemark.operators import runs as rq
    from tidemark.streaming import workers

    rows = [(f"a{k % 3}", f"2024-01-01 00:{k:02d}:00", None if k % 5 == 4 else f"2024-01-01 00:{k:02d}:02", "e" if k % 4 == 3 else None) for k in range(24)] + [("a0", "2024-01-01 00:00:00", "2024-01-01 00:00:02", None)]
    df = spark.createDataFrame(rows, "agent_id string, s string, f string, error string").selectExpr("agent_id", "cast(s as timestamp) started_at", "cast(f as timestamp) finished_at", "error")
    path, cp = str(tmp_path / "runs"), str(tmp_path / "cp")
    for part in (df.limit(10), df.where("agent_id <> 'a1'").limit(7), df.distinct()):
        part.write.mode("append").parquet(path)
        workers.start(spark.readStream.schema(df.schema).parquet(path), cp, None).awaitTermination()
    assert sorted(map(tuple, workers.stats(spark, cp).collect())) == sorted(map(tuple, rq.worker_stats(df.distinct()).select(workers.stats(spark, cp).columns).collect()))
    told = []
    query = workers.watched(spark.readStream.schema(df.schema).parquet(path), stale_ms=1).writeStream.foreachBatch(lambda b, _: told.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).start()
    until = time.time() + 60
    while time.time() < until and query.exception() is None and not any(x.stale for x in told):
        time.sleep(0.5)
    query.stop()
    assert {x.agent_id for x in told if x.stale} <= {"a0", "a1", "a2"} and any(x.stale for x in told)


def test_an_agents_runs_take_few_calls_to_the_state():
    """Each call is a round trip to the JVM: their number doesn't grow with an agent's runs. Runs given again, late ones and ones without a time count once."""
    from pyspark.sql import Row

    from tidemark.streaming import workers

    calls = []

    class Held:
        def __init__(self, **_):
            self.values, self.timers = {}, set()

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("getValueState", "getListState", "getMapState"):
                    return Held()
                if name in ("exists", "containsKey", "get"):
                    kept = self.values.get(a)
                    return bool(kept) if name != "get" else iter(self.values.get("list", [])) if "list" in self.values else kept
                if name == "update":
                    self.values[()] = a[0]
                elif name == "updateValue":
                    self.values[a[:1]] = a[1]
                elif name == "appendList":
                    self.values["list"] = self.values.get("list", []) + a[0]
                elif name == "registerTimer":
                    self.timers.add(a[0])
                elif name == "deleteTimer":
                    self.timers.remove(a[0])
                return list(self.timers) if name == "listTimers" else None

            return call

    class Now:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 1_000)  # noqa: N815

    run = lambda k: Row(started_us=k, finished_us=None if k is None else k + 5_000, error="e" if k and k % 4 == 3 else None)
    w, handle = workers.Worker(), Held()
    w.init(handle)
    calls.clear()
    for given, total, bad in ((range(0, 10_000, 2), 5_000, 0), ([*range(9_000, 11_000, 2), 11_003, 7, 7], 5_502, 2), ([None, None, 7, 10_998], 5_503, 2), ([None, 11_003, 11_005], 5_504, 2)):
        (out,) = w.handleInputRows(("a",), iter([run(k) for k in given]), Now)
        assert (out.total_runs, out.failed_runs, out.stale) == (total, bad, False)
    assert out.last_run_us == 11_005 and out.last_error is None and out.last_run_ms == 5 and len(handle.timers) == 1
    assert len(calls) <= 6 * 4
    handle.timers.clear()
    (out,) = w.handleExpiredTimer(("a",), Now, None)
    (out,) = [x for x in (out,) if x.stale and x.total_runs == 5_504]
    assert next(w.handleInputRows(("a",), iter([run(12_000)]), Now)).total_runs == 5_505


@pytest.fixture
def exposed():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = b'up 1\nhits{code="200"} 5 1700000000000\n' if self.path == "/metrics" else b""
            self.send_response(200 if self.path in ("/metrics", "/empty") else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1]
    server.shutdown()


def test_scrape_and_store(spark, tmp_path, exposed):
    r = Registry(spark, str(tmp_path / "log"))
    r.add(Agent("ok", "127.0.0.1", exposed)), r.add(Agent("none", "127.0.0.1", exposed, path="/empty")), r.add(Agent("bad", "127.0.0.1", exposed, path="/x")), r.add(Agent("off", "127.0.0.1", exposed, enabled=False))
    bodies = scrape.scrape(spark, r.agents())
    ingest.store_batch(bodies, str(tmp_path / "m"), str(tmp_path / "runs"))
    got = store.read_metrics(spark, str(tmp_path / "m")).collect()
    assert sorted((x["name"], x.value, x.agent_id) for x in got) == [("hits", 5.0, "ok"), ("up", 1.0, "ok")]
    runs = {x.agent_id: x for x in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert runs["ok"].status == "success" and runs["ok"].n_samples == 2 and runs["none"].status == "empty" and runs["bad"].status.startswith("failed: ") and "off" not in runs


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", f"up {i} {1700000000000 + i * 1000}") for i in range(50)]
    df = spark.createDataFrame(rows, "agent_id string, body string").selectExpr("agent_id", "timestamp'2024-01-01 00:00:00' as scraped_at", "body", "cast(null as string) as error")
    df.repartition(3).write.parquet(str(tmp_path / "bodies"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "bodies"))
    ingest.start(stream, str(tmp_path / "m"), str(tmp_path / "runs"), str(tmp_path / "cp"), every=None).awaitTermination()
    key = lambda d: sorted((r["name"], r.value, r.timestamp) for r in d.collect())
    assert key(store.read_metrics(spark, str(tmp_path / "m"))) == key(ingest.samples(df))
    live = spark.readStream.schema(store.read_metrics(spark, str(tmp_path / "m")).schema).parquet(str(tmp_path / "m"))
    out = ingest.drained(spark, ingest.aggregated(live, "7 minutes"), "agg_test")
    from tidemark.operators.metrics import bucketed

    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, bucketed(store.read_metrics(spark, str(tmp_path / "m")), "7 minutes").collect()))


def test_service(spark, tmp_path, exposed):
    from tidemark.api import Service

    s = Service(spark, str(tmp_path))
    assert s.metrics().isEmpty() and s.scraper_status().summary.first().active_workers == 0
    s.create(Agent("ok", "127.0.0.1", exposed)), s.create(Agent("bad", "127.0.0.1", exposed, path="/x"))
    s.scrape_due()
    assert {(r.id, r.last_scrape_status[:6]) for r in s.agents().collect()} == {("ok", "succes"), ("bad", "failed")}
    assert s.scraper_status().summary.first().total_errors == 1 and [r.agent_id for r in s.scraper_errors().collect()] == ["bad"]
    before = s.runs().count()
    s.scrape_due()  # no interval has passed
    assert s.runs().count() == before
    s.scrape_now("ok")
    assert s.runs().count() == before + 1
    with pytest.raises(Missing):
        s.scrape_now("none")
    s.save_metric("own", 1, "ok", {"a": "b"}, datetime.datetime(2024, 1, 1))
    (row,) = s.agent_metrics("ok", "2024-01-01", "2024-01-02").collect()
    assert [r["name"] for r in s.search("own", {"a": "b"}, "2024-01-01", "2024-01-02").collect()] == ["own"]
    assert [r.value for r in s.search("hits", {"code": "200", "agent_id": "ok"}, "2023-01-01", "2030-01-02").collect()] == [5.0, 5.0] and s.search("hits", {"code": "404"}, "2023-01-01", "2030-01-02").isEmpty()
    assert row["name"] == "own" and s.stats().first().total_agents == 2
    s.delete("ok", hard=True)
    assert not s.agent_metrics("ok", "2024-01-01", "2024-01-02").isEmpty()
    assert tuple(s.cycle(datetime.datetime(2024, 1, 1)).first())[:2] == (4, 2)
    assert sorted(w.agent_id for w in s.scraper_status().workers.collect()) == ["bad", "ok"]
    own = s.self_metrics().agg(F.sum("samples"), F.sum("agents"), F.sum("failed")).first()
    assert tuple(own) == (4, 3, 1)
    s.stop("bad")
    s.scrape_due(datetime.datetime.now() + datetime.timedelta(minutes=5))
    assert s.runs().count() == before + 1
    s.restart("bad")
    assert s.runs().count() == before + 2
    s.create(Agent("late", "127.0.0.1", exposed, scrape_interval_seconds=0)), s.registry.patch("bad", scrape_interval_seconds=1)
    query = s.start("1 second")
    s.create(Agent("later", "127.0.0.1", exposed))
    until = time.time() + 60
    while time.time() < until and query.exception() is None and s.runs().where("agent_id = 'bad'").count() < 3:
        time.sleep(1)
    while time.time() < until and query.exception() is None and s.runs().where("agent_id = 'later'").isEmpty():
        time.sleep(1)
    s.stop()
    assert not s.runs().where("agent_id = 'later'").isEmpty()
    assert query.exception() is None and not query.isActive and s.runs().where("agent_id = 'bad'").count() > 1


@pytest.mark.parametrize("width", ["1 month", "1 year", "7 days"])
def test_closed_buckets_are_appended_once(spark, tmp_path, width):
    """A stream in several batches, some of it out of order: buckets that the watermark has passed equal the batch's, and each comes once."""
    from tidemark.operators.metrics import bucketed
    from tidemark.streaming import calendar

    at = lambda d: datetime.datetime(2023, 11, 1) + datetime.timedelta(days=d)
    rows = [(float(i % 17) if i % 11 else None, at(i * 0.7)) for i in range(600)] + [(float("nan"), at(3))]
    df = spark.createDataFrame(rows, "value double, timestamp timestamp")
    for k, part in enumerate((rows[100::-1] + rows[-1:], rows[101:400], rows[400:600], [(0.0, at(3000))], [(0.0, at(3001))])):
        spark.createDataFrame(part, "value double, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = calendar.closed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), width, "2 days")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = {r.bucket.isoformat(): r for r in bucketed(df, width).withColumn("bucket", F.col("bucket").cast("timestamp")).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.bucket for r in got}) == len(got) and {r.bucket.isoformat() for r in got} == set(want)
    for r in got:
        w = want[r.bucket.isoformat()]
        assert repr(r.max_value) == repr(w.max_value) and (r.min_value, r.sample_count) == (w.min_value, w.sample_count) and (repr(r.avg_value) == repr(w.avg_value) or abs(r.avg_value - w.avg_value) < 1e-9)


def test_appended_windows_and_streams_of_months(spark, tmp_path):
    from tidemark.operators.metrics import bucketed

    rows = [(float(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "value double, timestamp timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    months = ingest.drained(spark, ingest.aggregated(stream, "1 month"), "months_test")
    assert sorted(map(tuple, months.collect())) == sorted(map(tuple, bucketed(df, "1 month").collect()))
    query = ingest.aggregated(stream, "7 days", watermark="1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = (sorted(map(tuple, d.collect())) for d in (spark.read.parquet(str(tmp_path / "out")), bucketed(df, "7 days")))
    assert 0 < len(got) < len(want) and got == want[: len(got)]


def test_bodies_from_files_and_dedup(spark, tmp_path):
    """Bodies kept as files are stored like scraped ones; a stream that drops repeats of a series and time keeps the first alone."""
    (tmp_path / "bodies").mkdir()
    for name, body in (("web-1.txt", 'hits{code="200"} 5 1700000000000\nhits{code="200"} 5 1700000000000\nhits{code="500"} 1 1700000000000\n'), ("web-2.txt", "# empty\n")):
        (tmp_path / "bodies" / name).write_text(body)
    bodies = scrape.bodies_from_files(spark, str(tmp_path / "bodies"))
    figures = ingest.store_batch(bodies, str(tmp_path / "m"), str(tmp_path / "r"))
    assert (figures["samples"], figures["agents"], figures["failed"]) == (3, 2, 0)
    assert {(x.agent_id, x.status, x.n_samples) for x in spark.read.parquet(str(tmp_path / "r")).collect()} == {("web-1", "success", 3), ("web-2", "empty", 0)}
    stored = store.read_metrics(spark, str(tmp_path / "m"))
    stream = ingest.deduplicated(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "m")), "1 hour")
    assert sorted((x["name"], x.tags["code"], x.value) for x in ingest.drained(spark, stream, "dedup_test", "append").collect()) == [("hits", "200", 5.0), ("hits", "500", 1.0)]
