"""Table upkeep, ingest and workflow."""

import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.functions.rules import Lexicon
from marketlens.operators import buyer_state, retention
from marketlens.operators import reviews as rv
from marketlens.operators import sales as sl
from marketlens.operators import workflow as wf
from marketlens.sources import comments as cm
from marketlens.sources import commits
from marketlens.sources import tables as tb
from marketlens.sources import text_index
from marketlens.streaming import ingest

LEX = Lexicon(positive=["good"], negative=["bad"], negation="not ", categories={"c": ["box"]}, danger=["fire"], warning=["refund"], known=["c", "other", "praise"], other="other", praise="praise")


def test_upsert_touches_only_its_columns_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "id int, v string, note string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "id int, v string, at int")
    once = tb.upsert(base, new.select("id", "v", "at"), ["id"], ["at"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "keep"), (2, "d", "keep"), (3, None, None)}
    assert {tuple(r) for r in tb.upsert(once, new, ["id"], ["at"]).collect()} == {tuple(r) for r in once.collect()}


def test_backfill(spark):
    base = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, v string")
    look = spark.createDataFrame([(1, "n"), (2, "n")], "id int, v string")
    assert {tuple(r) for r in tb.backfill(base, look, "id", ["v"]).collect()} == {(1, "n"), (2, "x"), (3, None)}
    assert tuple(tb.backfill_counts(base, look, "id", "v").first()) == (1, 1)


def test_percent_rank(spark):
    df = spark.createDataFrame([(v,) for v in [5, 3, 3, 1, 9, 9, 9, 2]], "v int")
    want = {r.v: r.p for r in df.selectExpr("v", "percent_rank() over (order by v desc) p").collect()}
    assert {r.v: r.percent_rank for r in tb.global_percent_rank(df, "v").collect()} == pytest.approx(want)


def test_row_numbers(spark):
    df = spark.createDataFrame([("a" if i % 5 else "b", i * 37 % 101) for i in range(100)], "k string, v int").repartition(7)
    want = {(r.k, r.v): r.n for r in df.selectExpr("k", "v", "row_number() over (partition by k order by v) n").collect()}
    assert {(r.k, r.v): r.nth for r in tb.row_numbers(df, "k", "v").collect()} == want


def test_export(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', None), ("b", "c")], "x string, y string")
    tb.export_csv(df, f"{tmp_path}/out")
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert part.read_text(encoding="utf-8-sig").splitlines() == ["x,y", '"say ""hi""",', '"b","c"']


def test_gates_and_logs(spark):
    empty = spark.createDataFrame([], "d date")
    some = spark.createDataFrame([(date(2024, 1, 5),)], "d date")
    assert tb.is_due(empty, "d", date(2024, 1, 6), 6) and not tb.is_due(some, "d", date(2024, 1, 10), 6) and tb.is_due(some, "d", date(2024, 1, 11), 6)
    assert tb.refresh_start(empty, "d", date(2024, 1, 1)) == date(2024, 1, 1) - timedelta(days=760)
    assert tb.refresh_start(some, "d", date(2024, 1, 31)) == date(2024, 1, 11)
    assert tb.run_log(spark, "partial", 3, 2, None, "m", datetime(2024, 1, 1)).count() == 1
    with pytest.raises(ValueError):
        tb.run_log(spark, "odd", 0, 0, None, "", datetime(2024, 1, 1))
    assert tb.introspect(some)[1] == 1 and tb.snapshot(some, 30, datetime(2024, 1, 1)).first().summary == '{"d":"2024-01-05"}'


def test_mapping(spark):
    raw = spark.createDataFrame([(7, "5", 1700000000, 0, ["a", ""]), (8, "x", 1700000000, 1700000001, None), (None, "1", 0, 0, None)], "id long, star string, ctime long, rtime long, pics array<string>")
    got = cm.normalize(cm.read_comments(raw, {"comment_id": "id", "rating": "star", "created_at": "ctime", "seller_reply_at": "rtime", "images": "pics", "brand": "gone"})).orderBy("comment_id").collect()
    assert [(r.comment_id, r.rating, r.images, r.brand, r.seller_reply_at is None) for r in got] == [("7", 5.0, ["a"], None, True), ("8", None, [], None, False)]
    links = spark.createDataFrame([("1", "2"), ("x", "2"), (None, "1")], "s string, i string").select(cm.storefront_link(F.col("s"), F.col("i"), "https://shop.example/"))
    assert [r[0] for r in links.collect()] == ["https://shop.example/1/2", None, None]


def test_weather_merge(spark):
    kind = "daily struct<time:array<string>,temperature_2m_mean:array<double>,precipitation_sum:array<double>>"
    archive = spark.createDataFrame([((["2024-01-01", "2024-01-02"], [20.0, None], [1.0, None]),)], kind)
    ahead = spark.createDataFrame([((["2024-01-02", "2024-01-03"], [21.0, 22.0], [2.0, 3.0]),)], kind)
    air = spark.createDataFrame([((["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-03T00:00"], [10.0, 11.5, None]),)], "hourly struct<time:array<string>,pm2_5:array<double>>")
    got = {str(r.date): (r.pm2_5, r.temp_mean, r.precip) for r in sl.merge_environment(archive, ahead, air).collect()}
    assert got == {"2024-01-01": (10.8, 20.0, 1.0), "2024-01-02": (None, 21.0, 2.0), "2024-01-03": (None, 22.0, 3.0)}


def _comments(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=m), t, r) for i, m, t, r in rows], "comment_id string, created_at timestamp, comment string, rating double")


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    target = f"{tmp_path}/target"
    first = _comments(spark, [("a", 0, "good", 5.0), ("b", 100, "bad box", 1.0), ("c", 120, "", 1.0)])
    assert ingest.ingest_batch(spark, first, target, LEX, datetime(2024, 1, 2)) == 2
    again = _comments(spark, [("a", 0, "late", 1.0), ("b", 101, "fire", 1.0), ("d", 130, "good", 4.0)])
    for _ in range(2):
        ingest.ingest_batch(spark, again, target, LEX)
    got = {r.comment_id: (r.comment, r.sentiment, r.severity) for r in commits.read(spark, target).collect()}
    assert got == {"a": ("good", "positive", 0), "b": ("fire", "negative", 9), "d": ("good", "positive", 0)}


def test_only_touched_days_are_rewritten(spark, tmp_path):
    target = f"{tmp_path}/days"
    rows = _comments(spark, [(str(k), k * 600, "good", 5.0) for k in range(8)])  # four days
    ingest.ingest_batch(spark, rows, target, LEX, datetime(2024, 1, 5))
    files = {f.part: f.path for f in commits.manifest(spark, target).folders}
    again = _comments(spark, [("7", 4201, "bad", 1.0), ("9", 5000, "good", 5.0)])
    ingest.ingest_batch(spark, again, target, LEX)
    after = {f.part: f.path for f in commits.manifest(spark, target).folders}
    assert [d for d in files if files[d] != after[d]] == ["2024-01-03"] and len(after) == 4
    assert {r.comment_id: r.sentiment for r in commits.read(spark, target).collect()} == {str(k): "positive" for k in range(7)} | {"7": "negative", "9": "positive"}
    later = spark.createDataFrame([("7", datetime(2024, 1, 9), "good", 5.0)], rows.schema)  # moves to another day
    ingest.ingest_batch(spark, later, target, LEX)
    assert commits.read(spark, target).filter("comment_id = '7'").count() == 1


def _days(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, d), v) for i, d, v in rows], "id string, day timestamp, v int").withColumn("day", F.to_date("day"))


def _state(df):
    return sorted((r.id, r.day.day, r.v) for r in df.collect())


OLD = [(str(i), 1 + i // 10, i) for i in range(40)]  # four days
NEW = [("5", 1, 500), ("12", 4, 1200), ("40", 4, 40), ("41", 6, 41)]  # one of the same day, one that moves, two new, one of them of a new day
AFTER = sorted([r for r in OLD if r[0] not in ("5", "12")] + NEW)


@pytest.mark.parametrize("at", ["files written", "manifest written", "manifest named"])
@pytest.mark.parametrize("first", [False, True])
def test_a_crash_leaves_one_state(spark, tmp_path, monkeypatch, at, first):
    path = f"{tmp_path}/t"
    if not first:
        commits.upsert(spark, path, _days(spark, OLD), ["id"], "day")
    new, want = (_days(spark, OLD), sorted(OLD)) if first else (_days(spark, NEW), AFTER)

    def stop(name):
        if name == at:
            raise KeyboardInterrupt(name)

    monkeypatch.setattr(commits, "_step", stop)
    with pytest.raises(KeyboardInterrupt):
        commits.upsert(spark, path, new, ["id"], "day")
    monkeypatch.undo()
    if at == "manifest named":
        assert _state(commits.read(spark, path)) == want
    elif first:
        assert not commits.exists(spark, path)
    else:
        assert _state(commits.read(spark, path)) == sorted(OLD)
    commits.upsert(spark, path, new, ["id"], "day")  # the run is repeated
    assert _state(commits.read(spark, path)) == want
    commits.vacuum(spark, path, 0)
    assert _state(commits.read(spark, path)) == want and len(commits.versions(spark, path)) == 1
    left = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t" / "_data").glob("*/day=*")}
    assert left == {f.path for f in commits.manifest(spark, path).folders}  # nothing of the crashed run stays


def test_a_crash_of_the_vacuum(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    commits.upsert(spark, path, _days(spark, OLD), ["id"], "day")
    commits.upsert(spark, path, _days(spark, NEW), ["id"], "day")
    assert _state(commits.read(spark, path, 1)) == sorted(OLD)  # the version before
    assert commits.vacuum(spark, path) == 0  # too young
    monkeypatch.setattr(commits, "_step", lambda name: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        commits.vacuum(spark, path, 0)
    monkeypatch.undo()
    assert _state(commits.read(spark, path)) == AFTER
    assert commits.vacuum(spark, path, 0) == 3 and _state(commits.read(spark, path)) == AFTER


def test_two_writers(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    commits.upsert(spark, path, _days(spark, OLD), ["id"], "day")
    pending = [_days(spark, [("99", 1, 99)])]

    def between(name):
        if name == "files written" and pending:  # another writer is faster, once
            commits.upsert(spark, path, pending.pop(), ["id"], "day")

    monkeypatch.setattr(commits, "_step", between)
    assert commits.upsert(spark, path, _days(spark, NEW), ["id"], "day") == 3
    assert _state(commits.read(spark, path)) == sorted([*AFTER, ("99", 1, 99)])
    pending.append(_days(spark, [("98", 2, 98)]))
    commits.change(spark, path, lambda df: df.filter("v < 1000"))
    assert _state(commits.read(spark, path)) == sorted([r for r in AFTER if r[2] < 1000] + [("99", 1, 99), ("98", 2, 98)])


def test_readers_never_fail_while_a_table_is_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    commits.upsert(spark, path, _days(spark, OLD), ["id"], "day")
    states, seen, done = [sorted(OLD)], [], threading.Event()
    for k in range(6):
        states.append(sorted([r for r in states[-1] if r[0] != "7"] + [("7", 1 + k % 3, 1000 + k)]))

    def look():
        while not done.is_set():
            seen.append(_state(commits.read(spark, path)))

    reader = threading.Thread(target=look)
    reader.start()
    try:
        for k in range(6):
            commits.upsert(spark, path, _days(spark, [("7", 1 + k % 3, 1000 + k)]), ["id"], "day")
            commits.vacuum(spark, path, 1)
    finally:
        done.set()
        reader.join()
    assert len(seen) > 3 and all(s in states for s in seen) and [states.index(s) for s in seen] == sorted(states.index(s) for s in seen)
    assert _state(commits.read(spark, path)) == states[-1]


def test_only_partitions_with_such_keys_are_searched(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(i, f"d{i // 10}") for i in range(50)] + [(None, None)], "id long, part string")
    commits.upsert(spark, path, rows, ["id"], "part")
    m = commits.manifest(spark, path)
    hit = commits._overlapping(spark, m, spark.createDataFrame([(9,), (10,)], "id long"))  # as text, 9 is above 10
    assert sorted(f.part for f in hit) == ["d0", "d1"]
    commits.upsert(spark, path, spark.createDataFrame([(9, "a=b/c%"), (None, None)], rows.schema), ["id"], "part")
    got = [(r.id, r.part) for r in commits.read(spark, path).collect()]
    assert (9, "a=b/c%") in got and (9, "d0") not in got and got.count((None, None)) == 2 and len(got) == 52


def test_whole_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.replace(spark.range(3), path)
    tb.upsert_table(spark, path, spark.range(2, 5), ["id"])
    assert sorted(r.id for r in commits.read(spark, path).collect()) == [0, 1, 2, 3, 4]
    tb.replace(commits.read(spark, path).filter("id > 9"), path)
    assert commits.read(spark, path).count() == 0 and commits.read(spark, path).columns == ["id"]
    with pytest.raises(FileNotFoundError):
        commits.read(spark, f"{tmp_path}/none")
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    with pytest.raises(ValueError):
        tb.replace(spark.range(3), f"{tmp_path}/plain")


def test_stream_equals_batch(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = _comments(spark, [(str(i), i, "good" if i % 2 else "bad", 3.0) for i in range(50)])
    rows.coalesce(1).write.parquet(source)
    for _ in range(2):
        q = ingest.stream_ingest(spark, source, rows.schema, target, f"{tmp_path}/checkpoint", LEX)
        q.awaitTermination(120)
        rows.filter("cast(comment_id as int) >= 40").coalesce(1).write.mode("append").parquet(source)
    one = f"{tmp_path}/batch"
    ingest.ingest_batch(spark, rows, one, LEX, datetime(2024, 1, 2))
    key = lambda p: sorted((r.comment_id, r.sentiment, r.severity) for r in commits.read(spark, p).collect())
    assert key(target) == key(one)
    assert ingest.best_effort([("x", lambda: 1 / 0), ("y", lambda: None)])[0] == "partial"


def test_stateful_stream_keeps_the_newest_copies(spark, tmp_path):
    """Files with newer, older, repeated and late copies, in several runs: the target holds the newest copy of all."""
    source, target, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    source.mkdir()
    files = [
        [("a", 0, "good", 5.0), ("b", 10, "bad", 1.0), ("c", 20, "good", 5.0)],
        [("a", 30, "bad", 1.0), ("b", 5, "good", 5.0), ("d", 25, "good", 4.0)],  # b's older copy is out of order
        [("a", 0, "good", 5.0), ("b", 10, "bad", 1.0), ("c", 20, "good", 5.0)],  # the first file again
        [("e", 300, "good", 5.0), ("e", 310, "bad", 1.0)],  # two copies in a batch
        [("a", 1, "good", 5.0), ("f", 290, "good", 5.0), ("e", 305, "good", 5.0)],
        [("g", 2000, "good", 5.0), ("b", 3, "good", 5.0), ("c", 20, "good", 5.0)],  # long behind the watermark
    ]
    progress = []
    for k, rows in enumerate(files):
        part = tmp_path / f"part{k}"
        _comments(spark, rows).coalesce(1).write.parquet(str(part))
        next(p for p in part.iterdir() if p.suffix == ".parquet").rename(source / f"{k}.parquet")
        if k in (1, 2, 5):  # runs that take up one or several files
            q = ingest.stream_newest(spark, str(source), _comments(spark, rows).schema, target, checkpoint, LEX, files_per_batch=1)
            q.awaitTermination(120)
            progress.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.comment_id: (r.created_at, r.comment) for r in commits.read(spark, target).collect()}
    newest = {i: (datetime(2024, 1, 1) + timedelta(minutes=m), t) for i, m, t, _ in sorted((r for f in files for r in f), key=lambda r: r[1])}
    assert got == newest
    assert progress[0] == 4 and progress[-1] == 1  # comments behind the watermark are forgotten


def test_triage_and_replies(spark):
    base = spark.createDataFrame([(1, "new", None, None, None), (2, "new", None, None, None)], "comment_id int, status string, assignee string, note string, handled_at timestamp")
    at = lambda m: datetime(2024, 1, 1, 0, m)
    patches = spark.createDataFrame([(1, "in_progress", "u", "n", at(1), "x"), (1, "resolved", "u", "n", at(2), "x"), (2, "odd", "u", "n", at(3), "x"), (9, "new", "u", "n", at(3), "x")], "comment_id int, status string, assignee string, note string, at timestamp, by string")
    after, log = wf.triage_patch(base, patches)
    assert {(r.comment_id, r.status, r.handled_at) for r in after.collect()} == {(1, "resolved", at(2)), (2, "new", None)} and log.count() == 2
    sent = spark.createDataFrame([(1, "failed", "t", at(4), "x"), (2, "sent", "t2", at(5), "x")], "comment_id int, outcome string, reply_text string, at timestamp, by string")
    after, _ = wf.apply_reply_outcomes(base, sent)
    assert {(r.comment_id, r.status, r.note, r.handled_at) for r in after.collect()} == {(1, "in_progress", "t", None), (2, "resolved", "t2", at(5))}


@pytest.mark.parametrize("kind", ["smart", "oldest", "severity", "rating", "newest"])
def test_pages_by_cursor_make_the_whole_order(spark, kind):
    rows = [(i, datetime(2024, 1, 1 + i % 5) if i % 7 else None, [None, 1.0, 4.0][i % 3], [None, 3, 9, 3][i % 4], ["new", "in_progress", "resolved", None][i % 4]) for i in range(47)]
    df = spark.createDataFrame(rows, "comment_id int, created_at timestamp, rating double, severity int, status string").repartition(3)
    want, keys, after, got = [r.comment_id for r in df.orderBy(*cm.comment_order(kind)).collect()], cm.comment_keys(kind), None, []
    while page := tb.seek(df, keys, after, 10).collect():
        got += [r.comment_id for r in page]
        after = page[-1].cursor
    assert got == want
    plan = tb.seek(df, keys, after, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan and "rangepartitioning" not in plan


def test_catalogue_takes_the_stock_of_the_own_platform(spark):
    demand = spark.createDataFrame([(1, date(2024, 1, 1), "A", 5.0), (2, date(2024, 1, 1), "B", 5.0), (3, date(2024, 1, 1), None, 5.0), (4, date(2024, 1, 1), "A", 1.0)], "product_id int, date date, platform string, units double")
    stock = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0), (2, "C", 4.0), (3, "A", 5.0), (3, "B", 6.0), (3, "B", 7.0)], "product_id int, platform string, stock double")
    as_of = F.lit("2024-01-10").cast("date")
    assert {r.product_id: r.stock for r in sl.product_catalog(demand, stock, as_of).collect()} == {1: 1.0, 2: 4.0, 3: 7.0, 4: None}
    assert {r.product_id: r.stock for r in sl.product_catalog(demand.drop("platform"), stock.drop("platform"), as_of).collect()} == {1: 2.0, 2: 4.0, 3: 7.0, 4: None}


def test_a_search_reads_the_files_that_may_hold_the_text(spark, tmp_path):
    path, index = f"{tmp_path}/t", f"{tmp_path}/index"
    rows = [(i, f"d{i % 6}", ["plain words here", "Ein Größe-Wort", "xyzzy only here", None, "", "ข้อความ ไทย"][i % 6]) for i in range(60)]
    commits.upsert(spark, path, spark.createDataFrame(rows, "id int, part string, comment string"), ["id"], "part")
    look = lambda q: text_index.candidates(spark, path, index, q)
    assert len(look("xyzzy").inputFiles()) == 6  # no index yet
    assert text_index.update(spark, path, index, "comment") == 6 and text_index.update(spark, path, index, "comment") == 0
    for q, files in (("xyzzy", 1), ("XYZZY", 1), ("größe", 1), ("ไทย", 1), ("here", 2), ("words xyzzy", 0), ("ab", 6), ("", 6)):
        got = look(q)
        assert len(got.inputFiles()) == files, q
        assert {r.id for r in cm.search(got, q=q).collect()} == {i for i, _, t in rows if t is not None and q.lower() in t.lower()} or q == ""
    commits.upsert(spark, path, spark.createDataFrame([(2, "d2", "gone"), (99, "d9", "a new xyzzy")], "id int, part string, comment string"), ["id"], "part")
    found = lambda: {r.id for r in cm.search(look("xyzzy"), q="xyzzy").collect()}
    want = {i for i, _, t in rows if t and "xyzzy" in t and i != 2} | {99}
    assert found() == want and text_index.update(spark, path, index, "comment") == 2 and found() == want
    assert len(look("xyzzy").inputFiles()) == 2 and len(look("plain").inputFiles()) == 1


def test_buyers_by_deltas_equal_the_full_build(spark, tmp_path):
    rnd = random.Random(4)
    orders = [(k, rnd.choice([1, 2, 3, 4, None]), rnd.choice(["COMPLETED", "COMPLETED", "OPEN"]), date(2024, 1 + k % 3, 1 + k % 28), rnd.choice(["x", "y", None])) for k in range(120)]
    items = [(k, float(k % 9), 1 + k % 3) for k in range(120) if k % 10] * 2
    schema = "order_sn int, buyer int, order_status string, create_date date, brand_id string"
    lines = spark.createDataFrame(items, "order_sn int, price double, quantity int").withColumn("price", F.col("price").cast("decimal(18,2)"))
    days, path = sorted({str(o[3]) for o in orders}), f"{tmp_path}/buyers"
    for part, known in ((days[:30], orders[:60]), (days[25:60], orders), (days[:40], orders), (days[40:], orders)):  # the first delta misses orders that its days' later delta brings
        buyer_state.apply_delta(spark, path, spark.createDataFrame(known, schema), lines, part)
    every = spark.createDataFrame(orders, schema)
    key = lambda df: sorted(map(repr, df.collect()))
    want = retention.buyer_base(every, lines)
    assert key(buyer_state.base(buyer_state.months(spark, path)).select(*want.columns)) == key(want.withColumn("spend", F.col("spend").cast("decimal(38,2)")))
    assert key(retention.retention_monthly(buyer_state.months(spark, path))) == key(retention.retention_monthly(every))
    assert key(retention.cohort_matrix(buyer_state.months(spark, path), "2024-06-01")) == key(retention.cohort_matrix(every, "2024-06-01"))
    fewer = [o for o in orders if str(o[3]) != days[3]]
    buyer_state.apply_delta(spark, path, spark.createDataFrame(fewer, schema), lines, [days[3]])  # all orders of a day are gone
    want = retention.buyer_base(spark.createDataFrame(fewer, schema), lines)
    assert key(buyer_state.base(buyer_state.months(spark, path)).select("buyer", "orders", "brands")) == key(want.select("buyer", "orders", "brands"))


def test_daily_metrics_trend(spark):
    overall = spark.createDataFrame([(5, 20.0, 1)], "total long, sentiment_score double, urgent_count long")
    brands = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "brand string, sentiment_score double")
    assert rv.daily_metrics(overall, brands, "2024-01-01").first().brand_scores == {"a": 2.0, "b": 1.0}
    days = spark.createDataFrame([(date(2024, 1, k),) for k in range(1, 11)], "date date")
    assert [r.date.day for r in rv.trend(days, 3).collect()] == [8, 9, 10] and [r.date.day for r in rv.trend(days, 3, "first").collect()] == [1, 2, 3]
    long = spark.createDataFrame([(date(2024, 1, 1), "a", 3), (date(2024, 1, 1), "b", 5), (date(2024, 1, 2), "b", 1), (date(2024, 1, 2), "c", 1)], "date date, category string, total long")
    wide = {str(r.date): (r.b, r.a) for r in rv.pivot_top(long, "category", "total", 2, True).collect()}
    assert wide == {"2024-01-01": (5, 3), "2024-01-02": (1, 0)}


def test_pivot_reads_its_rows_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(n):
        read.add(1)
        return n

    long = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-01", "b", 5), ("2024-01-02", "a", 2)], "date string, category string, n long")
    wide = rv.pivot_top(long.select("date", "category", seen("n").alias("total")), "category", "total", 2, True).collect()
    assert sorted((r.date, r.b, r.a) for r in wide) == [("2024-01-01", 5, 1), ("2024-01-02", 0, 2)] and read.value == 3
