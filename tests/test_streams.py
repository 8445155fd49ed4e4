import datetime

from panelyard.streaming import events as s

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows():
    t = datetime.datetime(2024, 1, 1)
    return [(i, t + datetime.timedelta(hours=5 * i), i % 3, "view" if i % 2 else "buy", i / 4) for i in range(60)]


def write(spark, path):
    data = rows()
    for part in (data[:20], data[20:40], data[40:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_a_stream_gives_what_the_static_frame_gives(spark, tmp_path):
    write(spark, f"{tmp_path}/in")
    static = spark.createDataFrame(rows(), SCHEMA)
    for name, fn in (("tumbling", s.tumbling), ("sessions", s.sessions)):
        s.run_once(fn(s.stream(spark, f"{tmp_path}/in", static.schema, 10)), name, f"{tmp_path}/{name}", "append")
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in fn(static).collect()}
        assert got and got <= want and len(want) - len(got) <= 12  # the last windows stay open behind the watermark


def test_cooldown_keeps_its_anchor_in_state(spark, tmp_path):
    write(spark, f"{tmp_path}/in")
    s.run_once(s.cooldown(s.stream(spark, f"{tmp_path}/in", SCHEMA and spark.createDataFrame([], SCHEMA).schema, 1), 40 * 3600), "cooled", f"{tmp_path}/c")
    want = []
    last = {}
    for _, t, u, _, _ in rows():
        if u not in last or (t - last[u]).total_seconds() >= 40 * 3600:
            last[u] = t
            want.append((u, t))
    assert sorted((r["user_id"], r["ts"]) for r in spark.table("cooled").collect()) == sorted(want)
