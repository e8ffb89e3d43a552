"""Streams agree with their batch twins, also over several micro-batches."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from strata.model import Config, Layer, Rule
from strata.operators import rules
from strata.streaming import state, watch

CHANGE = "project_id string, path string, op string, ts timestamp"
T0 = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches, schema, make, name="in"):
    """Write batches as files in order and drain a stream over them, one file per micro-batch."""
    folder = tmp_path / name
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        make(stream, str(tmp_path / f"{name}-check"))


def test_debounce_over_batches(spark, tmp_path, rows):
    def at(ms):
        return T0 + timedelta(milliseconds=ms)

    batches = [
        [("p", "a", "create", at(0)), ("p", "a", "write", at(100)), ("p", "b", "write", at(400))],
        [("p", "a", "remove", at(700)), ("q", "z", "write", at(50)), ("p", "c", "write", at(5000))],
        [("r", "end", "write", at(60000))],
    ]
    out = str(tmp_path / "out")
    feed(spark, tmp_path, batches, CHANGE, lambda s, c: watch.run_available(watch.debounce_changes(s, delay="10 seconds"), c, out=out))
    got = rows(spark.read.parquet(out), "project_id", "path", "op")
    assert got == [("p", "a", "remove"), ("p", "b", "write"), ("p", "c", "write"), ("q", "z", "write")]
    everything = spark.createDataFrame([r for b in batches for r in b], CHANGE)
    twin = rows(watch.debounce_batch(everything).where("project_id <> 'r'"), "project_id", "path", "op")
    assert twin == got
    # the same over several keys a project, joined afterwards
    split = str(tmp_path / "split")
    feed(spark, tmp_path, batches, CHANGE, lambda s, c: watch.run_available(watch.debounce_changes(s, delay="10 seconds", buckets=5), c, out=split), "in2")
    merged = watch.merge_bursts(spark.read.parquet(split))
    assert rows(merged, "project_id", "path", "op") == got
    assert {(r.path, r.burst) for r in merged.where("project_id = 'p'").collect()} == {("a", 1), ("b", 1), ("c", 2)}


VIOL = "project_id string, rule_id string, source_layer string, target_layer string, import_path string, file string, ts timestamp"


def test_change_feed_over_runs(spark, tmp_path, rows):
    def v(project, imp, day):
        return (project, "r" if imp else None, "a", "b", imp, "f", T0 + timedelta(days=day))

    batches = [
        [v("p", "x", 0), v("p", "y", 0), v("q", "x", 0), v("p", None, 0), v("q", None, 0)],
        [v("p", "y", 1), v("p", "z", 1), v("p", "old", 0), v("p", None, 1)],
        [v("p", None, 2)],  # a clean run
        [v("p", None, 3)],
    ]
    out = str(tmp_path / "out")
    feed(spark, tmp_path, batches, VIOL, lambda s, c: watch.run_available(watch.change_feed(s, buckets=3), c, out=out))
    found = spark.read.parquet(out)
    got = rows(found.where("run = 2"), "project_id", "import_path", "change")
    assert got == [("p", "x", "resolved"), ("p", "y", "unchanged"), ("p", "z", "added")]
    assert rows(found.where("run = 3"), "project_id", "import_path", "change") == [("p", "y", "resolved"), ("p", "z", "resolved")]
    # the second clean run has nothing to say, and q had one run only
    assert found.where("run > 3 or (project_id = 'q' and run > 1)").count() == 0
    assert found.where("ts is null or file is null").count() == 0


def test_newest_runs_of_a_log(spark, rows):
    log = [
        ("p", "r", "a", "b", "old", "f", T0), ("p", "r", "a", "b", "new", "f", T0 + timedelta(1)), ("p", "r", "a", "b", "new", "g", T0 + timedelta(1)),
        ("q", "r", "a", "b", "x", "f", T0), ("c", "r", "a", "b", "x", "f", T0), ("c", None, None, None, None, None, T0 + timedelta(2)),
    ]
    kept = watch.newest_runs(spark.createDataFrame(log, VIOL))
    assert rows(kept.fillna("-"), "project_id", "import_path", "file") == [("c", "-", "-"), ("p", "new", "f"), ("p", "new", "g"), ("q", "x", "f")]


def test_the_change_feed_query_is_given_newest_runs_only(spark, monkeypatch):
    """Every row of a micro-batch passes through Python, so a log's older runs stay out of it."""
    import pytest
    from pyspark.errors import AnalysisException

    from catalogue import QUERIES, streams

    given = []
    monkeypatch.setattr(streams, "arriving", lambda spark, parts, drain: given.extend(parts))
    with pytest.raises(AnalysisException):  # nothing was drained
        QUERIES["w4_change_feed"](spark, "/root/testdata/sf0.001")
    assert len(given) == 2
    for part in given:
        runs = part.groupBy("project_id").agg(F.countDistinct("ts").alias("n"), F.count("rule_id").alias("rows")).collect()
        assert runs and all(r.n == 1 and r.rows > 0 for r in runs)
        assert "SortMergeJoin" not in part._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_batch_changes_nothing(spark, tmp_path, rows):
    """A micro-batch whose commit is lost runs again from the state before it."""
    import shutil

    batch = [("p", None, None, None, None, None, T0), ("p", "r", "a", "b", "x", "f", T0)]
    later = [("p", None, None, None, None, None, T0 + timedelta(1)), ("p", "r", "a", "b", "z", "f", T0 + timedelta(1))]
    place, state, outs = tmp_path / "in", tmp_path / "check", [str(tmp_path / "one"), str(tmp_path / "two")]
    stream = lambda: watch.change_feed(spark.readStream.schema(VIOL).parquet(str(place)), buckets=2)
    spark.createDataFrame(batch, VIOL).write.parquet(str(place))
    watch.run_available(stream(), str(state), out=outs[0])
    spark.createDataFrame(later, VIOL).write.mode("append").parquet(str(place))
    kept = tmp_path / "kept"
    shutil.copytree(state, kept)
    watch.run_available(stream(), str(state), out=outs[0])
    watch.run_available(stream(), str(kept), each=lambda batch, epoch: batch.write.mode("append").parquet(outs[1]))
    want = [("x", "resolved", 2), ("z", "added", 2)]
    for out in outs:
        assert rows(spark.read.parquet(out).where("run = 2"), "import_path", "change", "run") == want


FILE = "project_id string, path string, op string, ts timestamp, content string"


def test_incremental_check(spark, tmp_path, rows):
    layers = (Layer("a", ("a/",)), Layer("b", ("b/",)))
    config = Config(layers, (Rule("r", "a", ("b",)),))

    def extract(files):
        return files.select(
            "project_id", F.col("path").alias("source_file"), F.lit(1).alias("source_line"), F.col("content").alias("import_path")
        )

    def check(imports, files):
        # an import is resolved while its file is there
        known = files.select("project_id", F.col("path").alias("import_path"))
        deps = imports.join(known, ["project_id", "import_path"]).withColumns(
            {"resolved_layer": F.substring_index("import_path", "/", 1), "language": F.lit("x")}
        )
        return rules.standard_violations(deps, config)

    day = lambda n: T0 + timedelta(n)
    batches = [
        [("p", "a/1", "write", day(0), "b/x"), ("p", "a/2", "write", day(0), "b/y"), ("p", "b/y", "write", day(0), "-"), ("q", "a/9", "write", day(0), "b/x")],
        [("p", "b/x", "write", day(1), "-"), ("p", "a/2", "remove", day(1), "")],
        [("p", "b/x", "remove", day(2), ""), ("p", "b/x", "write", day(1), "-")],
    ]
    out = str(tmp_path / "out")
    imports = spark.createDataFrame([], "project_id string, source_file string, source_line int, import_path string").schema
    body = watch.incremental_check(imports, check, out)
    feed(spark, tmp_path, batches, FILE, lambda s, c: watch.run_available(watch.project_snapshots(s, extract, buckets=3), c, each=body))
    result = spark.read.parquet(out)
    assert rows(result.where("epoch = 0"), "project_id", "file") == [("p", "a/2")]
    # an unchanged file sees the target that was added, and loses it again
    assert rows(result.where("epoch = 1"), "project_id", "file") == [("p", "a/1")]
    assert result.where("epoch = 2").count() == 0


def test_late_rows_are_dropped_by_rule(spark, tmp_path, rows):
    schema = "project_id string, severity string, ts timestamp"
    batches = [
        [("p", "error", T0 + timedelta(hours=1)), ("p", "error", T0 + timedelta(days=3))],
        [("p", "error", T0 + timedelta(hours=2)), ("p", "info", T0 + timedelta(days=5))],
    ]
    out = str(tmp_path / "out")

    def make(stream, check):
        watch.run_available(watch.violation_windows(stream, "1 day"), check, out=out)

    feed(spark, tmp_path, batches, schema, make)
    got = rows(spark.read.parquet(out), "window_start", "severity", "cnt")
    assert got == [(T0, "error", 1), (T0 + timedelta(days=3), "error", 1)]


class Kept:
    """A key's state, timers and clock, which counts the calls to them."""

    def __init__(self):
        self.calls, self.timers, self.rows, self.one, self.now = 0, set(), {}, None, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self._call(self.timers.add(at))

    def updateValue(self, key, value):
        self._call(self.rows.update({key: value}))

    def getValue(self, key):
        return self._call(self.rows.get(key))

    def removeKey(self, key):
        self._call(self.rows.pop(key))

    def containsKey(self, key):
        return self._call(key in self.rows)

    def iterator(self):
        return self._call(iter(list(self.rows.items())))

    def keys(self):
        return self._call(iter(list(self.rows)))

    def exists(self):
        return self._call(self.one is not None)

    def get(self):
        return self._call(self.one)

    def update(self, value):
        self.one = self._call(value)

    def getCurrentWatermarkInMs(self):
        return self.now


def told(frames):
    return [r for f in frames for r in f.itertuples(index=False, name=None)]


def test_bursts_call_the_state_once_a_frame():
    rng, second = random.Random(3), 1_000_000
    for spread, most in ((5000, 0.02), (10**5, None)):
        kept, made = Kept(), state.Bursts(30 * second)
        made.init(kept)
        events, found = [], []
        for batch in range(4):
            low = batch * spread * second
            new = [(rng.randrange(low, low + spread * second), f"f{rng.randrange(50)}", rng.choice("abc")) for _ in range(3000)]
            new = [(at, path, op) for at, path, op in new if at // 1000 > kept.now]
            events += new
            frame = pd.DataFrame(new, columns=["at", "path", "op"])
            frame["ts"] = pd.to_datetime(frame["at"], unit="us")
            list(made.handleInputRows(("p",), iter([frame[:1000], frame[1000:]]), kept))
            kept.now = (low + spread * second // 2) // 1000
            for due in sorted(t for t in kept.timers if t <= kept.now):
                kept.timers.discard(due)
                found += told(made.handleExpiredTimer(("p",), kept, None))
        kept.now = 10 * spread * 1000
        found += told(made.handleExpiredTimer(("p",), kept, None))
        assert not kept.rows
        bursts, want = [], []
        for event in sorted(events):
            if not bursts or event[0] - bursts[-1][-1][0] >= made.gap:
                bursts.append([])
            bursts[-1].append(event)
        for burst in bursts:
            last = {path: (at, op) for at, path, op in burst}
            want += [("p", burst[0][0], burst[-1][0], path, op, at) for path, (at, op) in last.items()]
        assert sorted(found) == sorted(want)
        assert most is None or kept.calls <= most * len(events)


def test_snapshots_call_the_state_once_a_thousand_files():
    rng, kept, made = random.Random(4), Kept(), state.Snapshots()
    made.init(kept)
    newest = {}
    for batch in range(6):
        rows = []
        for _ in range(6000 if batch < 2 else 3):
            path, version, gone = f"f{rng.randrange(9000)}", f"{rng.randrange(10**6):07d}", rng.random() < 0.2
            texts = [] if gone else [f"{version} {i}" for i in range(rng.randrange(3))]
            rows.append(("file", path, version, gone, None))
            rows += [("import", path, version, False, t) for t in texts]
            if path not in newest or newest[path][0] <= version:
                newest[path] = (version, gone, texts)
        frame = pd.DataFrame(rows, columns=["kind", "path", "version", "gone", "payload"])
        kept.calls = 0
        got = told(made.handleInputRows(("p",), iter([frame[:5000], frame[5000:]]), kept))
        want = [("p", "file", path, None) for path, (_, gone, _) in newest.items() if not gone]
        want += [("p", "import", path, t) for path, (_, gone, texts) in newest.items() for t in texts]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert kept.calls <= 60
    # a touch without changes writes nothing
    before = dict(kept.rows)
    touch = pd.DataFrame([("touch", None, None, False, None)], columns=["kind", "path", "version", "gone", "payload"])
    assert sorted(told(made.handleInputRows(("p",), iter([touch]), kept)), key=repr) == sorted(want, key=repr)
    assert kept.rows == before
