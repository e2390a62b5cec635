"""Files that land in several arrivals, crashes between any two steps, and documents that can't be read."""

import json

import pytest
from pyspark.sql import functions as F

from pulseloom import schemas
from pulseloom.sources import adapters, vendor
from pulseloom.streaming import landing

SF = "/root/testdata/sf0.001"


def doc(**fields):
    return json.dumps(fields)


def put(folder, kind, name, *lines):
    (folder / kind).mkdir(parents=True, exist_ok=True)
    (folder / kind / name).write_text("\n".join(lines) + "\n")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "checkpoint")


def arrivals(spark, n):
    """The documents of all events, as n lists of (kind, json)."""
    e = adapters.events(spark, SF)
    made = {"ring_heart_rate": adapters.ring_heart_rate_json(e), "ring_sleep": adapters.ring_sleep_json(e), "ring_readiness": adapters.ring_readiness_json(e), "fit_heart_rate": adapters.fit_json(e)}
    every = [(k, r.json) for k, df in made.items() for r in df.collect()]
    return [every[i::n] for i in range(n)]


def one_read(spark, docs):
    """What reading all documents at once gives."""
    parts = []
    for kind, (schema, normalise) in landing.KINDS.items():
        raw = spark.createDataFrame([(j,) for k, j in docs if k == kind], "json string")
        parts.append(normalise(vendor.parsed(raw, schema).filter("user_id is not null")))
    return vendor.union_samples(*parts)


def test_arrivals_and_crashes(spark, tmp_path, places):
    """Three arrivals; a crash before the samples, between samples and ledger, and after the ledger."""
    land, table, checkpoint = places
    parts = arrivals(spark, 3)

    def broken(when):
        def write(df, to, number):
            if when == "first":
                raise RuntimeError("crash")
            if when == "middle":
                real, landing.exists = landing.exists, lambda *a: False
                put_, calls = type(df.write).parquet, []

                def parquet(self, path, *a, **k):
                    calls.append(path)
                    if "/ledger/" in path:
                        raise RuntimeError("crash")
                    return put_(self, path, *a, **k)

                type(df.write).parquet = parquet
                try:
                    landing.take_up(df, to, number)
                finally:
                    type(df.write).parquet, landing.exists = put_, real
            landing.take_up(df, to, number)
            raise RuntimeError("crash")

        return write

    for i, (part, when) in enumerate(zip(parts, ("first", "middle", "last"), strict=True)):
        for kind in landing.KINDS:
            put(tmp_path / "landing", kind, f"{i}.json", *[j for k, j in part if k == kind])
        before = landing.samples(spark, table).count()
        with pytest.raises(Exception):  # noqa: B017
            landing.land(spark, land, table, checkpoint, write=broken(when)).awaitTermination()
        if when != "last":
            assert landing.samples(spark, table).count() == before  # nothing without a ledger is seen
        landing.land(spark, land, table, checkpoint).awaitTermination()
        landing.land(spark, land, table, checkpoint).awaitTermination()  # nothing new
        want = one_read(spark, [d for p in parts[: i + 1] for d in p])
        assert rows(landing.samples(spark, table), *vendor.COLUMNS) == rows(want, *vendor.COLUMNS)
    counts = landing.ledger(spark, table)
    assert counts.count() == 12 and counts.agg(F.sum("documents")).first()[0] == sum(map(len, parts))
    assert counts.agg(F.sum("samples")).first()[0] == landing.samples(spark, table).count()
    bad = landing.rejected(spark, table)
    assert bad.count() == counts.agg(F.sum("rejected")).first()[0] == sum(j == "{" for p in parts for _, j in p) > 50
    assert {r.reason for r in bad.collect()} == {"unreadable"}


def test_bad_documents(spark, tmp_path, places):
    land, table, checkpoint = places
    good = {"bpm": 60, "timestamp": "2024-01-01T00:00:00Z"}
    put(tmp_path / "landing", "ring_heart_rate", "a.json", doc(user_id=1, data=[good, {"bpm": None, "timestamp": "x"}], device="new", firmware={"v": 2}), "", "{", doc(data=[good]), doc(user_id="one", data=[good]), "[]", "null", doc(user_id=2, data=[good, good]))
    put(tmp_path / "landing", "scales", "b.json", doc(user_id=1))
    put(tmp_path / "landing", "ring_sleep", "c.json", doc(user_id=3, data=None))
    landing.land(spark, land, table, checkpoint, files_per_batch=1).awaitTermination()
    assert rows(landing.rejected(spark, table), "kind", "json", "reason") == sorted([
        ("ring_heart_rate", "", "empty"), ("ring_heart_rate", "{", "unreadable"), ("ring_heart_rate", doc(data=[good]), "no user"), ("ring_heart_rate", doc(user_id="one", data=[good]), "unreadable"),
        ("ring_heart_rate", "[]", "unreadable"), ("ring_heart_rate", "null", "unreadable"), ("scales", doc(user_id=1), "unknown kind")], key=repr)
    assert [r.user_id for r in landing.samples(spark, table).orderBy("user_id").collect()] == [1, 2, 2]
    got = {r.file.rsplit("/", 1)[1]: (r.documents, r.rejected, r.rescued, r.samples) for r in landing.ledger(spark, table).collect()}
    assert got == {"a.json": (8, 6, 1, 3), "b.json": (1, 1, 0, 0), "c.json": (1, 0, 0, 0)}
    assert {r.batch for r in landing.ledger(spark, table).collect()} == {0, 1, 2}


def test_rescued_fields(spark):
    raw = spark.createDataFrame([('{"user_id": 1, "data": [], "a": "x", "b": [1, 2]}',), ('{"user_id": 1}',), (None,)], "json string")
    got = vendor.checked(raw, schemas.RING_HEART_RATE).collect()
    assert [(r.reason, r.rescued) for r in got] == [(None, {"a": "x", "b": "[1,2]"}), (None, {}), ("empty", None)]


def test_sync_on_request(spark, tmp_path, places):
    land, table, checkpoint = places
    asked = spark.createDataFrame([(1, None), (2, False)], "request_id long, synced boolean")
    put(tmp_path / "landing", "ring_heart_rate", "a.json", doc(user_id=1, data=[{"bpm": 60, "timestamp": "2024-01-01T00:00:00Z"}]))
    assert landing.sync(spark, asked, land, table, checkpoint) == [] and landing.ledger(spark, table).count() == 0
    asked = asked.withColumn("synced", F.lit(True))
    assert landing.sync(spark, asked, land, table, checkpoint) == [{"source": "oura", "samples_pushed": 1, "error": None}, {"source": "google_fit", "samples_pushed": 0, "error": None}]
    assert [r["samples_pushed"] for r in landing.sync(spark, asked, land, table, checkpoint)] == [0, 0]
    failed = landing.sync(spark, asked, str(tmp_path / "nowhere"), table, str(tmp_path / "other"))
    assert all(r["error"] and r["samples_pushed"] == 0 for r in failed)


def files(path):
    import os

    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_writes_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "samples")

    def sync(*rows):
        ddl = "user_id long, metric_type string, value double, unit string, start string, source string"
        df = spark.createDataFrame(list(rows), ddl).withColumn("start_time", F.to_timestamp("start")).withColumn("end_time", F.to_timestamp("start"))
        return df.select(*vendor.COLUMNS)

    def have():
        return rows(spark.read.schema(schemas.SAMPLE).parquet(path).select("user_id", "value", F.date_format("start_time", "yyyy-MM-dd HH").alias("at"), "source"))

    a, b, c = ((1, "heart_rate", v, "bpm", f"2024-01-0{d}T05:00:00Z", "oura") for d, v in ((1, 60.0), (2, 70.0), (3, 80.0)))
    assert vendor.upsert(sync(a, b, b), path) == 2
    first = files(path)
    assert vendor.upsert(sync(a, b), path) == 0 and files(path) == first  # the same rows again
    assert vendor.upsert(sync(b, c), path) == 1
    assert {k: v for k, v in files(path).items() if k in first} == first  # a new day leaves the others as they are
    second = files(path)
    assert vendor.upsert(sync((1, "heart_rate", 71.0, "bpm", "2024-01-02T05:00:00Z", "oura"), (1, "heart_rate", 61.0, "bpm", "2024-01-02T06:00:00Z", "oura"), a), path) == 1
    assert {k.split("day=")[1][:10] for k in set(second) - set(files(path))} == {"2024-01-02"}
    assert have() == [(1, 60.0, "2024-01-01 05", "oura"), (1, 61.0, "2024-01-02 06", "oura"), (1, 71.0, "2024-01-02 05", "oura"), (1, 80.0, "2024-01-03 05", "oura")]
    assert vendor.upsert(sync((None, "heart_rate", None, None, "2024-01-03T05:00:00Z", "oura"), (None, "heart_rate", None, None, "2024-01-03T05:00:00Z", "oura")), path) == 1
    assert vendor.upsert(sync((None, "heart_rate", None, None, "2024-01-03T05:00:00Z", "oura")), path) == 0
    assert vendor.upsert(sync(a).limit(0), path) == 0 and len(have()) == 5


def counting(spark):
    """A step that passes rows of text on, and the number of rows that have passed it."""
    passed = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    return (lambda df: df.mapInArrow(run, df.schema)), passed


def test_documents_are_parsed_once(spark, tmp_path, places, monkeypatch):
    """However many writes need a document, it passes into the parser once."""
    (part,), (step, passed), real = arrivals(spark, 1), counting(spark), vendor.checked
    for kind in landing.KINDS:
        put(tmp_path / "landing", kind, "a.json", *[j for k, j in part if k == kind])
    monkeypatch.setattr(vendor, "checked", lambda raw, schema: real(step(raw), schema))
    landing.land(spark, *places).awaitTermination()
    assert passed.value == len(part) == landing.ledger(spark, places[1]).agg(F.sum("documents")).first()[0]
    assert rows(landing.samples(spark, places[1]), *vendor.COLUMNS) == rows(one_read(spark, part), *vendor.COLUMNS)


def test_pushed_samples_are_made_once(spark, tmp_path):
    """They are counted as they are written, one file a day."""
    (step, passed), path = counting(spark), str(tmp_path / "samples")
    at = F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")))
    made = spark.range(0, 1000, 1, 20).select(F.col("id").alias("user_id"), F.lit("heart_rate").alias("metric_type"), F.lit(60.0).alias("value"), F.lit("bpm").alias("unit"), at.alias("start_time"), at.alias("end_time"), F.lit("oura").alias("source"))
    got = vendor.sync_sources({"oura": lambda: step(made), "google_fit": lambda: made.limit(0)}, path)
    assert [r["samples_pushed"] for r in got] == [1000, 0] and not any(r["error"] for r in got)
    assert 1000 <= passed.value < 2000  # the look for a first row makes one partition
    assert spark.read.schema(schemas.SAMPLE).parquet(path).count() == 1000 and len(files(path)) == 3
    assert vendor.push(made, path) == 1000 and spark.read.schema(schemas.SAMPLE).parquet(path).count() == 2000
