"""Streams give what the tables give."""

import json
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docaudit.streaming import progress as P


def run(spark, tmp_path, stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}.checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def files(spark, tmp_path, rows, schema, parts=3):
    folder = tmp_path / "in"
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def lines():
    rng, start = random.Random(1), datetime(2026, 1, 1)
    out = []
    for i in range(60):
        kind = rng.choice(["page", "page", "page", "document", "stage", "done"])
        event = {"kind": kind, "page": i, "total": 60, "name": f"d{i}", "doc_type": "scheme", "index": i, "path": "p", "stage": f"s{i}"}
        line = f"{P.MARKER} {json.dumps(event)}" if i % 9 else ("log" if i % 2 else P.MARKER + " {bad")
        out.append((f"s{i % 3}", start + timedelta(seconds=i), i, line))
    return out


SCHEMA = "session string, ts timestamp, seq bigint, line string"


def test_latest_progress(spark, tmp_path):
    stream = P.latest_progress_stream(P.parse_progress(files(spark, tmp_path, lines(), SCHEMA)))
    rows = run(spark, tmp_path, stream, "update", "progress_latest").collect()
    last = {}
    for r in rows:  # rows come batch by batch
        last[r.session] = r
    want = {r.session: r for r in P.latest_progress(P.parse_progress(spark.createDataFrame(lines(), SCHEMA))).collect()}
    assert {k: tuple(v) for k, v in last.items() if v.document or v.stage} == {k: tuple(v) for k, v in want.items()}


def test_parse_drops_what_is_no_event(spark):
    got = P.parse_progress(spark.createDataFrame(lines(), SCHEMA))
    assert {r.seq for r in got.collect()} == {i for i in range(60) if i % 9}


def chunks(text, rng):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, 4)
        out.append(text[at : at + n])
        at += n
    return out


def test_reasoning_over_chunks(spark, tmp_path):
    rng, start = random.Random(2), datetime(2026, 1, 1)
    texts = ["a<think>b</think>c", "<thi nk><think>open to the end", "no tags < at all", "x<think></think>y<think>z</think>"]
    rows = sorted(((f"s{i}", start + timedelta(seconds=j), j, c) for i, t in enumerate(texts) for j, c in enumerate(chunks(t, rng))), key=lambda r: r[2])
    schema = "session string, ts timestamp, seq bigint, text string"
    stream = P.split_reasoning_stream(files(spark, tmp_path, rows, schema))
    got = run(spark, tmp_path, stream, "append", "reasoning").groupBy("session", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t")).collect()
    got = {(r.session, r.kind): r.t for r in got}
    want = {r.session: (r.reasoning, r.content) for r in P.split_reasoning_chunks(spark.createDataFrame(rows, schema)).collect()}
    for s, (reasoning, content) in want.items():
        assert (got.get((s, "reasoning"), ""), got.get((s, "content"), "")) == (reasoning, content)


def test_throttle(spark, tmp_path):
    start = datetime(2026, 1, 1)
    at = [0.0, 0.1, 0.2, 0.5, 0.6, 2.0, 2.1, 2.2, 5.0, 5.1]
    kinds = ["page", "page", "page", "page", "page", "page", "page", "stage", "page", "page"]
    rows = [("s", start + timedelta(seconds=a), i, k, i) for i, (a, k) in enumerate(zip(at, kinds, strict=True))]
    schema = "session string, ts timestamp, seq bigint, kind string, page int"
    want = sorted((r.seq, r.late) for r in P.throttle(spark.createDataFrame(rows, schema)).collect())
    assert want == [(0, False), (3, False), (4, True), (5, False), (7, False), (8, False), (9, True)]
    got = run(spark, tmp_path, P.throttle_stream(files(spark, tmp_path, rows, schema, 1)), "append", "throttled").collect()
    assert sorted(r.seq for r in got if not r.late) == [0, 3, 5, 7, 8]  # held pages come by a timer, which an input that has ended may not wait for


def test_speeds(spark):
    start = datetime(2026, 1, 1)
    rows = [("a", 1, 30, 2.0), ("a", 2, 10, 4.0), ("a", 3, 0, 1.0), ("b", 1, 5, 0.0)]
    got = P.generation_speed(spark.createDataFrame(rows, "session string, seq int, tokens bigint, seconds double")).collect()
    assert [tuple(r) for r in got] == [("a", 2.5, 10)]
    rows = [("a", 1, start + timedelta(seconds=i), 50 if i == 4 else None) for i in range(5)]
    got = P.chunk_speed(spark.createDataFrame(rows, "session string, reply int, ts timestamp, usage bigint")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 50, 4.0, 12.5)]


def test_a_timer_shows_the_last_page_and_drops_the_state(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [("s", start + timedelta(seconds=a), i, "page", i) for i, a in enumerate([0.0, 0.1, 0.2])]
    folder, schema = tmp_path / "in", "session string, ts timestamp, seq bigint, kind string, page int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    stream = P.throttle_stream(spark.readStream.schema(schema).parquet(str(folder)))
    q = stream.writeStream.format("memory").queryName("throttled_by_timer").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 90
        state = None
        while time.time() < until:
            got = sorted((r.seq, r.late) for r in spark.table("throttled_by_timer").collect())
            state = q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsTotal"]
            if len(got) == 2 and state == 0:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == [(0, False), (2, True)] and state == 0


def test_speeds_are_merged_by_batch(spark, tmp_path):
    table = P.SpeedTable(spark, str(tmp_path / "speeds"))
    schema = "session string, seq bigint, ts timestamp, tokens bigint, seconds double"
    rng, start = random.Random(4), datetime(2026, 1, 1)
    rows = [(f"s{rng.randint(0, 5)}", i, start + timedelta(seconds=i), rng.randint(0, 50), float(rng.randint(0, 4))) for i in range(90)]
    q = files(spark, tmp_path, rows, schema).writeStream.foreachBatch(table.merge).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = {tuple(r) for r in P.generation_speed(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in table.frame().collect()} == want
    table.merge(spark.createDataFrame(rows[60:], schema), 2)  # a batch that runs again replaces what it wrote
    assert {tuple(r) for r in table.frame().collect()} == want and table.rows().count() <= 18
    small = table.compacted(str(tmp_path / "compacted"))
    small.merge(spark.createDataFrame([("s0", 1000, start, 30, 2.0)], schema), 3)
    assert {tuple(r) for r in small.frame().collect()} == {r for r in want if r[0] != "s0"} | {("s0", 15.0, 30)}


def figures(chunks, interval):
    """Brute force of one reply: running figures and the last one."""
    out, told, first = [], None, chunks[0][0]
    for n, (at, usage) in enumerate(chunks, 1):
        if usage is not None:
            return [*out, (usage, round(at - first, 3), round(usage / (at - first), 1), True)]
        if at > first and (told is None or at - told >= interval):
            told = at
            out.append((n, round(at - first, 3), round(n / (at - first), 1), False))
    return out


def test_speed_of_running_replies(spark, tmp_path):
    rng, start = random.Random(6), datetime(2026, 1, 1)
    rows, want = [], {}
    for reply in range(4):
        at, own = 0.0, []
        for i in range(40):
            at += rng.choice([0.125, 0.25, 0.5])
            own.append((at, 77 if i == 39 and reply < 3 else None))
            rows.append(("s", reply, i, start + timedelta(seconds=at), own[-1][1]))
        want[reply] = figures(own, 0.4)
    rows.sort(key=lambda r: r[3])
    # Long after, so that the watermark passes the reply that never said its usage.
    rows += [("t", 9, 0, start + timedelta(days=1), None), ("t", 9, 1, start + timedelta(days=2), None)]
    schema = "session string, reply int, seq int, ts timestamp, usage bigint"
    folder = tmp_path / "in"
    for part in (rows[:100], rows[100:-2], rows[-2:-1], rows[-1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = P.chunk_speed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    got = run(spark, tmp_path, stream, "append", "running_speed").filter("session = 's'").collect()
    by = {}
    for r in got:
        by.setdefault(r.reply, []).append((r.tokens, r.seconds, r.tps, r.final))
    assert {k: sorted(v) for k, v in by.items() if k < 3} == {k: sorted(v) for k, v in want.items() if k < 3}
    last = max(by[3])
    assert last[0] == 40 and last[3] and sorted(x for x in by[3] if not x[3]) == sorted(want[3])
