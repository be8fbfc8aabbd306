"""The task log, pages, streams, files written, and whole jobs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import project
from scribeloom import scale, schemas
from scribeloom.operators import tasks
from scribeloom.options import Options, OutputOptions, RetryOptions
from scribeloom.plans import jobs
from scribeloom.sources import outputs, segments, symbols, task_log
from scribeloom.streaming import queue, task_events


def log(spark, rows):
    """rows: task, status, seq and any other columns by name."""
    full = [{"task_id": t, "status": s, "seq": n, "class_fqn": "c.A", "method": "run()", "file": "f", "line": 1, "annotation": "@R",
             "created_at": n, "progress": 0.5, "scope": "METHOD", "attempt": 0, **more} for t, s, n, more in rows]
    columns = ("task_id string, status string, seq bigint, class_fqn string, method string, file string, line int, annotation string, "
               "created_at bigint, progress double, scope string, attempt int, message string, cg_summary string, error_type string, error_message string")
    names = [c.split()[0] for c in columns.split(", ")]
    return task_log.complete(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], columns))


def test_latest_history_and_counts(spark):
    df = log(spark, [("a", "QUEUED", 1, {}), ("b", "QUEUED", 2, {}), ("a", "RUNNING", 3, {}), ("c", "FAILED", 4, {}), ("a", "SUCCEEDED", 5, {})])
    assert {r["task_id"]: r["status"] for r in tasks.latest(df).collect()} == {"a": "SUCCEEDED", "b": "QUEUED", "c": "FAILED"}
    assert [r["task_id"] for r in tasks.history(df, 2).collect()] == ["a", "c"]
    status = tasks.queue_status(tasks.latest(df), Options()).first()
    assert (status["queued_count"], status["failed_count"], status["running"], status["queue_size"], status["backlog_size"]) == (1, 1, False, 1, 0)


def test_search(spark):
    df = log(spark, [("Alpha", "FAILED", 1, {"message": None, "cg_summary": "SEE"}), ("b", "QUEUED", 2, {"message": "Alpha"}), ("d", "FAILED", 3, {})])
    found = lambda *a: sorted(r["task_id"] for r in tasks.search(df, *a).collect())
    assert found("ALL", "alpha") == ["Alpha", "b"]
    assert found("FAILED", "ALPHA") == ["Alpha"]
    assert found("ALL", "see") == ["Alpha"]
    assert found("FAILED", "  ") == ["Alpha", "d"]


def test_descending_order_turns_ties_too(spark):
    df = log(spark, [(t, s, n, {}) for n, (t, s) in enumerate([("b", "QUEUED"), ("a", "FAILED"), ("c", "QUEUED"), ("d", "CANCELLED")])])
    up = [r["task_id"] for r in tasks.sort_tasks(df, "STATUS", True).collect()]
    assert up == ["b", "c", "a", "d"]
    assert [r["task_id"] for r in tasks.sort_tasks(df, "STATUS", False).collect()] == up[::-1]


@pytest.mark.parametrize("by,ascending", [("CREATED_AT", False), ("STATUS", True)])
def test_pages_by_rank(spark, by, ascending):
    df = spark.range(5000).select(
        F.format_string("t%05d", "id").alias("task_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("created_at"),
        F.when(F.col("id") % 3 > 0, "FAILED").otherwise("QUEUED").alias("status"),
    )
    order = [r["task_id"] for r in tasks.sort_tasks(df, by, ascending).collect()]
    for index, narrow in ((0, 10**5), (120, 50), (10**6, 50)):
        rows = tasks.page(df, index, 20, by, ascending, narrow_to=narrow).collect()
        index = min(index, 249)
        assert sorted((r["row_no"], r["task_id"]) for r in rows) == [(index * 20 + i + 1, order[index * 20 + i]) for i in range(20)]
    assert tasks.page_info(df, 300, -4) == (5000, 17, 0)
    assert tasks.page_info(df.limit(0), 300, 5) == (0, 0, 0)
    assert tasks.page(df.limit(0), 5, 20, by).count() == 0


def test_pages_of_equal_rows_are_apart(spark):
    df = spark.range(900).select(F.lit("t").alias("task_id"), F.lit(1).alias("created_at"), F.lit(0.5).alias("progress"))
    for index in (0, 7, 44):
        rows = tasks.page(df, index, 20, "PROGRESS", True, narrow_to=50).collect()
        assert sorted(r["row_no"] for r in rows) == [index * 20 + i + 1 for i in range(20)]


def test_pages_write_nothing_and_read_keys_only(spark, monkeypatch, tmp_path):
    wide = spark.range(3000).select(
        F.format_string("t%05d", "id").alias("task_id"), F.col("id").alias("created_at"), F.repeat(F.lit("x"), 100).alias("message")
    )
    wide.write.parquet(str(tmp_path / "wide"))
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *a, **k: pytest.fail("a page is written"))
    plans = []
    monkeypatch.setattr(tasks, "_bounds", lambda keys, real=tasks._bounds: plans.append(keys._jdf.queryExecution().toString()) or real(keys))
    df = spark.read.parquet(str(tmp_path / "wide"))
    assert tasks.page(df, 70, 20, narrow_to=100).count() == 20
    assert plans and all("message" not in p.split("ReadSchema")[-1] for p in plans)


def test_retry_and_recovery(spark):
    df = log(spark, [
        ("a", "FAILED", 1, {"attempt": 0, "error_type": "HttpTimeoutException"}), ("b", "FAILED", 2, {"attempt": 2, "error_message": "Request TIMED OUT"}),
        ("c", "RUNNING", 3, {"error_type": "Old"}), ("d", "CANCELLED", 4, {}), ("e", "FAILED", 5, {"scope": "CLASS", "method": "CLASS"}), ("f", "SUCCEEDED", 6, {"error_type": "timeout"}),
    ])
    failed = tasks.failed(df).withColumn("failed_at", F.lit(100).cast("bigint"))
    got = {r["task_id"]: (r["status"], r["attempt"], r["due_at"], r["error_message"]) for r in tasks.decide_retry(failed).collect()}
    assert got == {"a": ("PARTIAL", 1, 1600, "error"), "b": ("FAILED", 2, None, "Request TIMED OUT"), "e": ("PARTIAL", 1, 1600, "error")}
    assert {r["status"] for r in tasks.decide_retry(failed, RetryOptions(enabled=False)).collect()} == {"FAILED"}
    due = tasks.requeue_due(tasks.decide_retry(failed), F.lit(1600))
    assert {(r["task_id"], r["status"]) for r in due.collect()} == {("a", "QUEUED"), ("e", "QUEUED")}
    back = tasks.recover_pending(df).collect()
    assert [(r["task_id"], r["status"], r["progress"], r["message"], r["error_type"]) for r in back] == [("c", "QUEUED", 0.0, "Auto-resume", "Old")]
    assert {r["task_id"] for r in tasks.timed_out(df).collect()} == {"a", "b"}
    again = tasks.run_again(tasks.by_ids(df, spark.createDataFrame([("e",), ("e",)], "task_id string")), F.lit(9).cast("bigint")).collect()
    assert [(r["task_id"], r["scope"], r["status"]) for r in again] == [("c.A#CLASS#9", "CLASS", "QUEUED")]


def test_log_round_trip(spark, tmp_path):
    df = log(spark, [("a", "FAILED", 1, {"error_type": "X", "message": "m"}), ("b", "QUEUED", 2, {})])
    task_log.append_log(df, str(tmp_path / "log"))
    task_log.append_log(df.where("seq = 1").withColumn("seq", F.lit(3).cast("bigint")), str(tmp_path / "log"))
    back = task_log.read_log(spark, str(tmp_path / "log"))
    assert back.count() == 3 and back.schema.names == df.schema.names
    nested = {r["task_id"]: r for r in task_log.to_tasks(df).collect()}
    assert nested["a"]["error"] == ("X", "") and nested["b"]["error"] is None
    assert nested["a"]["progress"] == (0.5, "m") and nested["a"]["entry"]["class_fqn"] == "c.A"
    assert task_log.to_log(task_log.to_tasks(df)).count() == 2
    with pytest.raises(PySparkException, match="unknown status"):
        task_log.to_tasks(df.withColumn("status", F.lit("LOST"))).collect()


def test_documents_written_and_found(spark, tmp_path):
    docs = spark.createDataFrame(
        [("c.A#get(int)#5", "c.A", "METHOD", "m 1", "text", None, "ctx"), ("c.B#CLASS#6", "c.B", "CLASS", None, "whole", "{}", None)],
        "task_id string, class_fqn string, scope string, module string, markdown string, json string, context string",
    )
    table = str(tmp_path / "out")
    for _ in range(2):  # a run that is repeated replaces its own rows
        outputs.write_outputs(docs, table, OutputOptions(group_by_module=True), run=1, repeat=True)
    with pytest.raises(ValueError):
        outputs.write_outputs(docs, table, run=1)
    got = {(r["kind"], r["module"], r["path"], r["content"]) for r in outputs.read_outputs(spark, table).collect()}
    assert got == {
        ("md", "m 1", "md/m_1/c/A/c.A_get_int__5.md", "text"), ("docs", "m 1", "docs/m_1/c/A/c.A_get_int__5.doc", "text"),
        ("context", "m 1", "context-bundles/c.A_get_int__5.txt", "ctx"), ("md", "none", "md/c.B_CLASS_6.md", "whole"),
        ("docs", "none", "docs/c.B_CLASS_6.doc", "whole"), ("json", "none", "method-docs/c.B_CLASS_6.json", "{}"),
    }
    assert outputs.list_output_table(spark, table).count() == 4
    # A later run keeps the documents of the run before and replaces equal paths.
    later = docs.where("scope = 'CLASS'").withColumn("markdown", F.lit("new"))
    assert outputs.write_outputs(later, table, OutputOptions(group_by_module=True, write_doc=False)) == 2
    kept = {r["path"]: r["content"] for r in outputs.read_outputs(spark, table).collect()}
    assert len(kept) == 6 and kept["md/c.B_CLASS_6.md"] == "new" and kept["docs/c.B_CLASS_6.doc"] == "whole"
    assert outputs.list_output_table(spark, table).count() == 4
    assert outputs.output_rows(docs, OutputOptions(write_markdown=False, write_doc=False)).count() == 2


def test_files_listed(spark, tmp_path):
    assert outputs.list_output_files(spark, str(tmp_path)).count() == 0
    for name in ("docs/a/c.A_x_1.md", "docs/c.B.DOC", "docs/skip.txt", "md/c.C.md", "md/c.D.doc", "other/c.E.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["path"] for r in outputs.list_output_files(spark, str(tmp_path)).collect()}
    assert got == {"docs/a/c.A_x_1.md", "docs/c.B.DOC", "md/c.C.md"}


def test_symbols_and_sources_round_trip(spark, tmp_path):
    t = project.tables(spark)
    symbols.write_symbols(t, str(tmp_path / "s"))
    back = symbols.read_symbols(spark, str(tmp_path / "s"))
    for name in t:
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, t[name].collect()))
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/X.java").write_text("one\r\ntwo", newline="")
    (tmp_path / "src/a/X.kt").write_text("no")
    got = symbols.read_source_files(spark, str(tmp_path / "src"), "app").collect()
    assert [(r["module"], r["path"].endswith("/src/a/X.java"), r["content"]) for r in got] == [("app", True, "one\r\ntwo")]


def test_stream_of_states_equals_the_batch(spark, tmp_path):
    """Several batches, rows out of order, and a second run with nothing new."""
    rows = [(f"t{i % 40}", ("QUEUED", "RUNNING", "FAILED")[i % 3], (i * 37) % 1000, {}) for i in range(400)]
    df = log(spark, rows).withColumn("updated_at", F.timestamp_seconds(F.col("seq") * 60)).repartition(4)
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        task_events.stream_latest(stream, out, state).awaitTermination()
    got = sorted((r["task_id"], r["status"], r["seq"]) for r in task_events.read_latest(spark, out).collect())
    assert got == sorted((r["task_id"], r["status"], r["seq"]) for r in tasks.latest(df).collect())

    counted, state2 = str(tmp_path / "counted"), str(tmp_path / "state2")
    one = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    task_events.stream_window_counts(one, counted, state2, "2 hours").awaitTermination()
    closed = df.groupBy(F.window("updated_at", "2 hours").alias("w"), "status").count()
    end = df.agg(F.max("updated_at") - F.expr("interval 10 minutes")).first()[0]
    want = {(r["w"]["start"], r["status"], r["count"], r["w"]["end"] <= end) for r in closed.collect()}
    found = task_events.read_window_counts(spark, counted, "10 minutes").collect()
    assert {(r["window_start"], r["status"], r["events"], r["closed"]) for r in found} == want
    assert len({flag for *_, flag in want}) == 2


def test_equal_paths_of_one_run_keep_the_later_task(spark, tmp_path):
    docs = spark.createDataFrame(
        [("c.A#f()#5", "c.A", "METHOD", None, "old", 1), ("c.A#f[]#5", "c.A", "METHOD", None, "new", 2)],
        "task_id string, class_fqn string, scope string, module string, markdown string, created_at bigint",
    )
    table = str(tmp_path / "out")
    assert outputs.write_outputs(docs, table, OutputOptions(write_doc=False)) == 0
    assert outputs.write_outputs(docs.limit(0), table) == 1
    assert [r["content"] for r in outputs.read_outputs(spark, table).collect()] == ["new"]


def test_appended_rows_are_stamped_and_found(spark, tmp_path):
    queued = jobs.scan(project.tables(spark), spark.createDataFrame([], "path string"), Options(annotation="Rpc"))
    task_log.append_log(queued, str(tmp_path / "log"))
    task_log.append_log(queued.limit(1).withColumn("status", F.lit("SUCCEEDED")), str(tmp_path / "log"))
    states = [r["status"] for r in tasks.latest(task_log.read_log(spark, str(tmp_path / "log"))).collect()]
    assert sorted(states) == ["QUEUED"] * (len(states) - 1) + ["SUCCEEDED"]
    nulls = task_log.read_log(spark, str(tmp_path / "log")).withColumn("seq", F.lit(None).cast("bigint"))
    assert tasks.latest(nulls).where("status is null").count() == 0


def test_known_module_without_entries_queues_nothing(spark):
    t = project.tables(spark)
    extra = t["classes"].limit(1).withColumn("module", F.lit("empty")).withColumn("class_fqn", F.lit("e.E"))
    t = {**t, "classes": t["classes"].unionByName(extra)}
    none = spark.createDataFrame([], "path string")
    every = jobs.scan(t, none, Options(annotation="Rpc")).count()
    assert jobs.scan(t, none, Options(annotation="Rpc", module="empty")).count() == 0
    assert jobs.scan(t, none, Options(annotation="Rpc", module="nowhere")).count() == every


ENTRIES = "class_fqn string, method string, file string, line int, annotation string"
NO_INDEX = "class_fqn string, method_key string, base_name string, kind string"


def test_streamed_entries_are_queued_once(spark, tmp_path):
    rows = [("c.A", "done(int)", "f", 1, "@R"), ("c.A", "x()", "g", 2, "@R"), ("c.A", "x()", "f", 3, "@R"), ("c.A", "x()", "f", 2, "@R")]
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    done = spark.createDataFrame([("c.A", "done_int", "done", "METHOD")], NO_INDEX)

    def run():
        stream = spark.readStream.schema(ENTRIES).parquet(src)
        queue.stream_queue(stream, done, out, state, F.lit(1).cast("bigint")).awaitTermination()
        return sorted((r["task_id"], r["file"], r["line"]) for r in spark.read.parquet(out).collect())

    spark.createDataFrame(rows, ENTRIES).write.parquet(src)
    assert run() == [("c.A#x()#1", "f", 2)]
    spark.createDataFrame([rows[1], ("c.B", "y()", "g", 1, "@R")], ENTRIES).write.mode("append").parquet(src)
    assert run() == [("c.A#x()#1", "f", 2), ("c.B#y()#1", "g", 1)]


def test_a_batch_costs_its_own_entries_not_the_queue(spark, tmp_path, monkeypatch):
    """The queue is never read again, and state is written for keys of the batch only."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for n in range(4):
        made = spark.range(n * 100, n * 100 + 120).select(
            F.lit("c.A").alias("class_fqn"), F.concat(F.lit("m"), "id", F.lit("()")).alias("method"), F.lit("f").alias("file"),
            F.col("id").cast("int").alias("line"), F.lit("@R").alias("annotation"),
        )
        made.coalesce(1).write.mode("append").parquet(src)
    reads = []
    monkeypatch.setattr(queue, "read_queue", lambda s, p, real=queue.read_queue: reads.append(p) or real(s, p))
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(src)
    query = queue.stream_queue(stream, spark.createDataFrame([], NO_INDEX), out, state, F.lit(1).cast("bigint"))
    query.awaitTermination()
    assert reads == [out]  # before the first batch
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [120] * 4
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 420
    assert spark.read.parquet(out).count() == 420 and spark.read.parquet(out).select("task_id").distinct().count() == 420


def test_a_new_stream_leaves_what_is_queued(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("c.A", "x()", "f", 1, "@R"), ("c.A", "y()", "f", 2, "@R")], ENTRIES).write.parquet(src)
    old = spark.createDataFrame([("c.A", "x()", "f", 1, "@R")], ENTRIES)
    tasks.new_tasks(old, F.lit(0).cast("bigint")).write.parquet(f"{out}/batch_id=-1")
    stream = spark.readStream.schema(ENTRIES).parquet(src)
    queue.stream_queue(stream, spark.createDataFrame([], NO_INDEX), out, str(tmp_path / "state"), F.lit(1).cast("bigint")).awaitTermination()
    assert sorted(r["task_id"] for r in spark.read.parquet(out).collect()) == ["c.A#x()#0", "c.A#y()#1"]


def test_states_of_many_batches_lie_in_few_segments(spark, tmp_path):
    """A merge that dies half-way loses nothing, and a batch that comes twice adds nothing."""
    path, schema = str(tmp_path / "t"), schemas.TASK_LOG
    rows = [log(spark, [(f"t{i % 5}", "RUNNING", i, {}), (f"u{i}", "QUEUED", i, {})]) for i in range(14)]

    def die(df):
        raise RuntimeError("lost")

    for i, df in enumerate(rows):
        assert segments.add(df, path, i)
        assert not segments.add(df, path, i)
        if i == 8:
            with pytest.raises(RuntimeError):
                segments.compact(spark, path, schema, die, fanout=3)
        segments.compact(spark, path, schema, tasks.latest, fanout=3)
        found = segments.manifest(spark, path).segments
        assert len(found) <= 2 * 3 and sorted(n for s in found for n in range(s.first, s.last + 1)) == list(range(i + 1))
    assert not segments.add(rows[0], path, 0)  # merged long ago
    every = rows[0]
    for df in rows[1:]:
        every = every.unionByName(df)
    want = sorted((r["task_id"], r["seq"]) for r in tasks.latest(every).collect())
    assert sorted((r["task_id"], r["seq"]) for r in task_events.read_latest(spark, path).collect()) == want
    assert len(segments.unnamed(spark, path)) >= 9
    assert segments.read(spark, str(tmp_path / "none"), schema).count() == 0


def test_writers_of_one_version_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "n int")
    other = []

    def step(m):
        if not other:  # another writer comes first
            other.append(1)
            segments.add(df, path, 7)
        return m._replace(taken=m.taken + 1)

    segments.change(spark, path, step)
    now = segments.manifest(spark, path)
    assert [s.first for s in now.segments] == [7] and now.taken == 9
    assert [segments.take_number(spark, path) for _ in range(3)] == [9, 10, 11]
    with pytest.raises(ValueError):
        for i in range(3):
            segments.add(df, path, 20 + i)
        segments.compact(spark, path, "n int", fanout=4)
        segments.add(df, path, 21, replace=True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_with_hot_keys(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select((F.col("id") * 2 % 60).alias("k")).distinct().withColumn("b", F.col("k") * 10)
    if how == "inner":
        right = right.unionByName(spark.range(40).select(F.lit(7).cast("bigint").alias("k"), F.col("id").alias("b")))
    hot_left = scale.find_hot(left, ["k"], share=10, floor=100)
    hot_right = scale.find_hot(right, ["k"], share=4, floor=10) if how == "inner" else None
    assert [r["k"] for r in hot_left.collect()] == [0]
    assert hot_right is None or [r["k"] for r in hot_right.collect()] == [7]
    got = scale.skew_join(left, right, ["k"], how, hot_left=hot_left, hot_right=hot_right)
    want = left.join(right, ["k"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_first_rows_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), ((F.col("id") * 7919) % 3001).alias("n"))
    got = {}
    for r in scale.first_rows(df, ["k"], ["n"], 5).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["n"]))
    for k in {r["k"] for r in df.collect()}:
        numbers = sorted(r["n"] for r in df.where(F.col("k") == k).collect())[:5]
        assert sorted(got[k]) == [(i + 1, n) for i, n in enumerate(numbers)]
        if k > 3:
            break


def test_shared_folder_comes_from_the_session(spark):
    assert scale.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = scale.materialize(spark.range(5))
    assert kept.inputFiles()[0].replace("file://", "").startswith(scale.shared_dir(spark))
    assert kept.count() == 5


def test_from_scan_to_documents(spark, tmp_path):
    t = project.tables(spark)
    options = Options(annotation="@Rpc")
    done = spark.createDataFrame([("docs/app/com.shop.OrderService_check_OrderDTO__99.md",)], "path string")
    at = F.lit(7).cast("bigint")
    queued = jobs.scan(t, done, options, at)
    ids = {r["task_id"] for r in queued.collect()}
    assert ids == {f"{project.S}#get(String)#7", "com.lib.My_Odd#settle()#7", "Bare#address()#7"}
    by_class = jobs.scan(t, done, Options(annotation="RpcService", per_class=True), at)
    both = queued.unionByName(by_class)
    asked = {r["task_id"]: r for r in jobs.requests(t, both, options).collect()}
    assert set(asked) == ids | {f"{project.S}#CLASS#7"}
    assert asked[f"{project.S}#CLASS#7"]["context"] == project.class_text(project.S, options.context)
    assert asked[f"{project.S}#get(String)#7"]["context"] == project.method_text(project.S, "get(String)", options.context)
    replies = spark.createDataFrame(
        [(f"{project.S}#get(String)#7", 200, "```md\nfine\n```", 50), ("Bare#address()#7", 503, "busy", 50)],
        "task_id string, http_status int, body string, failed_at bigint",
    )
    good, bad = jobs.documents(replies, queued, options)
    assert [(r["task_id"], r["markdown"]) for r in good.collect()] == [(f"{project.S}#get(String)#7", "fine")]
    assert [(r["task_id"], r["status"], r["due_at"], r["error_message"]) for r in bad.collect()] == [("Bare#address()#7", "PARTIAL", 1550, "HTTP 503 — busy")]

    # What is written and logged is done: a second scan queues the rest only.
    table, logs = str(tmp_path / "out"), str(tmp_path / "log")
    outputs.write_outputs(good, table, options.output)
    task_log.append_log(queued, logs)
    task_log.append_log(good, logs)
    task_log.append_log(jobs.requeue(bad, F.lit(2000).cast("bigint")), logs)
    again = jobs.scan(t, outputs.list_output_table(spark, table).union(done), options, at)
    assert {r["task_id"] for r in again.collect()} == ids - {f"{project.S}#get(String)#7"}
    states = {r["task_id"]: r for r in tasks.latest(task_log.read_log(spark, logs)).collect()}
    row = states[f"{project.S}#get(String)#7"]
    assert (row["status"], row["progress"], row["message"]) == ("SUCCEEDED", 1.0, "Done")
    assert {row["md_path"], row["doc_path"]} == {r["path"] for r in outputs.read_outputs(spark, table).collect()}
    assert states["Bare#address()#7"]["status"] == "QUEUED" and states["Bare#address()#7"]["attempt"] == 1


def test_task_ids_stay_the_same_when_computed_again(spark):
    queued = jobs.scan(project.tables(spark), spark.createDataFrame([], "path string"), Options(annotation="Rpc"))
    first = sorted(r["task_id"] for r in queued.collect())
    assert first and first == sorted(r["task_id"] for r in queued.collect())


def test_resume_job(spark):
    t = project.tables(spark)
    lines = spark.createDataFrame([(1, f"{project.S}#get"), (2, "Bare#address()"), (3, f"{project.S}#CLASS")], "line_no bigint, line string")
    history = spark.createDataFrame([("Bare", "address()", "METHOD", "SUCCEEDED")], "class_fqn string, method string, scope string, status string")
    got = jobs.resume_list(lines, t, history, Options(annotation="Rpc"), created_at=F.lit(1).cast("bigint"))
    assert {r["task_id"] for r in got.collect()} == {f"{project.S}#get(String)#1", f"{project.S}#CLASS#1"}
    every = jobs.resume_list(lines, t, history, Options(annotation="Rpc"), skip_succeeded=False, created_at=F.lit(1).cast("bigint"))
    assert every.count() == 3


def test_a_log_orders_its_own_rows(spark, tmp_path, monkeypatch):
    """Two states of a task in one append, appends within a millisecond, a clock
    that steps back, and an append that is tried again."""
    path = str(tmp_path / "log")
    both = log(spark, [("a", "SUCCEEDED", 1, {}), ("a", "RUNNING", 2, {}), ("b", "RUNNING", 3, {})]).drop("seq", "updated_at")
    assert task_log.append_log(both, path, "one")
    assert not task_log.append_log(both, path, "one")
    assert task_log.read_log(spark, path).count() == 3
    state = lambda: {r["task_id"]: r["status"] for r in tasks.latest(task_log.read_log(spark, path)).collect()}
    assert state() == {"a": "SUCCEEDED", "b": "RUNNING"}
    early = log(spark, [("b", "FAILED", 1, {}), ("a", "QUEUED", 1, {"attempt": 1})]).drop("seq").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    task_log.append_log(early, path)
    assert state() == {"a": "QUEUED", "b": "FAILED"}
    timed = log(spark, [("b", "PARTIAL", 1, {}), ("b", "QUEUED", 2, {})]).withColumn("updated_at", F.timestamp_seconds(F.when(F.col("status") == "QUEUED", 9).otherwise(8)))
    task_log.append_log(timed.drop("seq"), path)
    assert state()["b"] == "QUEUED"
    numbers = [r["seq"] for r in task_log.read_log(spark, path).where("task_id = 'b'").collect()]
    assert len(set(numbers)) == 4


def test_documents_are_computed_once_and_seen_whole(spark, tmp_path, monkeypatch):
    table, calls = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        return text

    counted = F.udf(count, "string").asNondeterministic()
    docs = spark.createDataFrame(
        [(f"c.A#f{i}()#5", "c.A", "METHOD", None, "x", i) for i in range(6)],
        "task_id string, class_fqn string, scope string, module string, markdown string, created_at bigint",
    ).withColumn("markdown", counted("markdown"))
    outputs.write_outputs(docs, table)
    assert calls.value == 6
    sizes = {r["path"]: r["size"] for r in outputs.written_paths(spark, table).collect()}
    assert len(sizes) == 12 and set(sizes.values()) == {1}
    # A run that dies before its paths are in the manifest is not there.
    with monkeypatch.context() as m:
        m.setattr(segments, "add", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            outputs.write_outputs(docs.limit(1), table)
    assert outputs.runs(spark, table) == [0] and outputs.read_outputs(spark, table).count() == 12
    assert outputs.write_outputs(docs.limit(1), table) == 1
    assert outputs.list_output_table(spark, str(tmp_path / "none")).count() == 0
    assert outputs.read_outputs(spark, str(tmp_path / "none")).count() == 0


def test_entries_of_one_name_in_two_modules_are_apart(spark):
    t = project.tables(spark)
    copy = lambda df, c: df.withColumn(c, F.concat(F.lit("/copy"), c))
    t["classes"] = t["classes"].unionByName(copy(t["classes"], "file").withColumn("module", F.lit("zz")))
    t["methods"] = t["methods"].unionByName(copy(t["methods"], "file"))
    t["source_files"] = t["source_files"].unionByName(copy(t["source_files"], "path").withColumn("module", F.lit("zz")))
    none, options = spark.createDataFrame([], "path string"), Options(annotation="@Rpc")
    queued = jobs.scan(t, none, options, F.lit(7).cast("bigint"))
    rows = queued.collect()
    assert len({r["task_id"] for r in rows}) == len(rows) and {r["created_at"] for r in rows} == {7, 8}
    assert tasks.name_collisions(queued).count() == 0
    asked = {r["task_id"]: r for r in jobs.requests(t, queued, options).collect()}
    for n, file in ((7, "/p/app/OrderService.java"), (8, "/copy/p/app/OrderService.java")):
        context = asked[f"{project.S}#get(String)#{n}"]["context"]
        assert context.count("# Entry Method") == context.count("# Method Source") == 1 and f"## File: {file} [" in context
    first = queued.where("created_at = 7")
    twice = first.unionByName(first.withColumn("task_id", F.concat("task_id", F.lit("1"))))
    assert jobs.requests(t, twice, options).count() == 2 * first.count()  # two tasks of an entry share its text


def test_batches_of_the_queue_may_have_many_files(spark, tmp_path, monkeypatch):
    from workload import tasklog

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(tasklog, "scratch_path", lambda _, label: f"{tmp_path}/made-{label}")
    found = tasklog.stream_queue_batches(spark, str(tmp_path))
    assert found.count() == found.select("class_fqn", "method").distinct().count() > 0
    # No task holds a whole batch.
    assert len(list((tmp_path / "made-documents").glob("part-*"))) > 4


def test_a_task_writes_few_pieces_at_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outputs, "FILE_CHARS", 1000)
    docs = spark.range(400).selectExpr(
        "concat('C', id, '#f()') AS task_id", "concat('C', id) AS class_fqn", "'METHOD' AS scope", "'a' AS module", "repeat('x', 100) AS markdown"
    )
    outputs.write_outputs(docs, str(tmp_path), OutputOptions(write_doc=False))
    assert outputs.read_outputs(spark, str(tmp_path)).count() == 400
    rows = [spark.read.parquet(str(f)).count() for f in tmp_path.glob("part=*/kind=*/module=*/part-*")]
    # 40 pieces of about ten rows, in tasks of their own: not eight tasks for all.
    assert len(rows) > 16 and max(rows) <= 80
