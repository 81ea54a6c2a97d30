"""Keyed state of registrations: each kind of event, a restart between files, equal to the same steps one key after another."""

import datetime
import random

import pandas as pd

from rostrum.streaming import registrations as G

T0 = datetime.datetime(2024, 1, 1)


def test_steps():
    at = lambda d: pd.Timestamp(T0 + datetime.timedelta(days=d))
    state, seen = None, []
    for d, content, present in [(0, "a", True), (1, "a", True), (2, "b", True), (3, "b", False), (4, "b", False), (5, "b", True), (6, "b", False), (7, "c", True), (6, "z", True), (17, "c", True), (28, "d", True), (29, "c", True)]:
        state, what = G.step(state, at(d), content, present)
        seen.append(what)
    assert seen == ["new", None, "changed", "withdrawn", None, "returned", "withdrawn", "returned", "late", None, "late", "late"]
    assert state == ("c", 3, at(0), at(17), False, 2, True)


def test_stream_with_a_restart(spark, tmp_path):
    spark = spark.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", G.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rng = random.Random(3)
    readings = []
    for key in range(12):
        day = rng.randint(0, 5)
        for _ in range(rng.randint(1, 9)):
            readings.append((f"k{key}", T0 + datetime.timedelta(days=day, hours=key), rng.choice("ab"), rng.random() < 0.7))
            day += rng.choice([1, 1, 2, 3, 12])
    readings.append(("last", T0 + datetime.timedelta(days=200), "a", True))
    readings.sort(key=lambda r: r[1])
    schema = "key string, ts timestamp, content string, present boolean"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    third = len(readings) // 3
    for part in (readings[:third], readings[third : 2 * third], readings[2 * third :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = G.followed(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.key, r["at"], r.event, r.revision, r.withdrawn, r.returns) for r in spark.read.parquet(out).collect() if r.event != "final")
    want, states = [], {}
    for key, at, content, present in readings:
        states[key], what = G.step(states.get(key), pd.Timestamp(at), content, present)
        if what:
            s = states[key]
            want.append((key, at, what, s[1], s[4], s[5]))
    assert got == sorted(want)
    final = sorted((r.key, r["at"], r.revision, r.withdrawn) for r in spark.read.parquet(out).where("event = 'final'").collect())
    assert final == sorted((k, (s[3] + pd.Timedelta(days=G.FREEZE_DAYS)).to_pydatetime(), s[1], s[4]) for k, s in states.items() if k != "last")


def test_query_is_its_batch_twin(spark):
    """Every event of the small table, by the same steps one person after another."""
    from rostrum.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = sorted((r.key, r["at"], r.event, r.revision, r.withdrawn, r.returns) for r in catalogue.QUERIES["stream_registrations"](spark, sf).collect() if r.event != "final")
    want, states = [], {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_type, r.value >= 10)):
        key = str(r.user_id)
        states[key], what = G.step(states.get(key), pd.Timestamp(r.ts), r.event_type, r.value >= 10)
        if what:
            s = states[key]
            want.append((key, r.ts, what, s[1], s[4], s[5]))
    assert got == sorted(want) and len({w[2] for w in want}) > 3
