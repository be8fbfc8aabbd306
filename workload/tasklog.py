"""Queries on the task log, its streams, and the files and tables written."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeloom.functions import text
from scribeloom.operators import generate, index, tasks
from scribeloom.options import Options, OutputOptions, RetryOptions
from scribeloom.plans import jobs
from scribeloom.scale import materialize, scratch_path
from scribeloom.sources import outputs, symbols, task_log
from scribeloom.streaming import queue, task_events
from workload import data
from workload.context import CONTEXT, STUB_SQL
from workload.data import LOG, SRC, TAGGED, sql
from workload.selection import WORDS

SHORT = ("task_id", "class_fqn", "method", "status", "progress", "message", "scope", "error_type", "error_message", "attempt", "seq")


def latest_tasks(spark, folder):
    return tasks.latest(data.task_log(spark, folder)).select(*SHORT, "created_at", "file", "line", "annotation")


def history_limit(spark, folder):
    return tasks.history(data.task_log(spark, folder), 50).select("task_id", "status", "seq")


def queue_status(spark, folder):
    return tasks.queue_status(tasks.latest(data.task_log(spark, folder)), Options(queue_size=10)).select(
        "queued_count", "running_count", "partial_count", "succeeded_count", "failed_count", "cancelled_count",
        "total_count", "running", "queue_size", "backlog_size", "queue_remaining_capacity",
    )


def status_counts(spark, folder):
    return tasks.status_counts(tasks.latest(data.task_log(spark, folder)))


def search_tasks(spark, folder):
    return tasks.search(data.task_log(spark, folder), "FAILED", "U1").select("task_id", "message", "seq")


def search_messages(spark, folder):
    return tasks.search(data.task_log(spark, folder), "ALL", '"K": 9').select("task_id", "message", "seq")


def _orders(spark, folder):
    """Orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("PARTIAL")
    return data.table(spark, folder, "orders").select(
        F.format_string("t%09d", "o_orderkey").alias("task_id"), status.alias("status"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("class_fqn"), F.col("o_orderpriority").alias("method"),
        F.col("o_custkey").alias("created_at"), (F.col("o_totalprice") / 600000).alias("progress"),
    )


def sorted_tasks(spark, folder):
    return tasks.sort_tasks(_orders(spark, folder), "ENTRY", True).select("task_id", "class_fqn", "method", "status")


def task_page(spark, folder):
    return tasks.page(_orders(spark, folder), 3, 20, "STATUS", True).select("row_no", "task_id", "status")


def last_task_page(spark, folder):
    return tasks.page(_orders(spark, folder), 10**9, 20, "CREATED_AT").select("row_no", "task_id", "created_at")


def deep_task_page(spark, folder):
    """A page in the middle, narrowed down by ranges."""
    return tasks.page(_orders(spark, folder), 37, 20, "ENTRY", False, narrow_to=10_000).select("row_no", "task_id", "class_fqn")


def retry_decisions(spark, folder):
    failures = data.task_log(spark, folder).where("status = 'FAILED'").withColumn("failed_at", F.col("created_at"))
    decided = tasks.decide_retry(failures, RetryOptions())
    due = F.coalesce("due_at", F.lit(-1).cast("bigint")).alias("due_at")
    return decided.select("task_id", "seq", "status", "attempt", due, "error_message")


def recover_pending(spark, folder):
    return tasks.recover_pending(data.task_log(spark, folder)).select(*SHORT)


def rerun_failed(spark, folder):
    old = tasks.failed(tasks.latest(data.task_log(spark, folder)))
    return tasks.run_again(old, F.lit(77).cast("bigint")).select("task_id", "class_fqn", "method", "scope", "status", "created_at", "attempt")


def rerun_timeouts(spark, folder):
    old = tasks.timed_out(tasks.latest(data.task_log(spark, folder)))
    again = tasks.run_again(old, F.lit(78).cast("bigint"))
    return again.select("task_id", "class_fqn", "method", "scope", "status", "created_at", "attempt")


def rerun_by_ids(spark, folder):
    ids = data.table(spark, folder, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") * 3).cast("string")).alias("task_id"))
    return tasks.by_ids(tasks.latest(data.task_log(spark, folder)), ids).select("task_id", "status", "seq")


def queued_tasks(spark, folder):
    created = (F.col("line") * 1000).cast("bigint")
    return tasks.new_tasks(data.entries(spark, folder), created).select("task_id", "class_fqn", "method", "scope", "status", "created_at")


def _stream(spark, folder, name):
    table = data.table(spark, folder, name)
    return spark.readStream.schema(table.schema).parquet(f"{folder}/{name}*.parquet")


def stream_latest(spark, folder):
    out, state = scratch_path(spark, "latest"), scratch_path(spark, "latest-state")
    log = data.task_log_of(_stream(spark, folder, "events"))
    task_events.stream_latest(log, out, state).awaitTermination()
    return task_events.read_latest(spark, out).select(*SHORT)


def stream_latest_batches(spark, folder):
    """The same from twelve batches, merged in levels of three."""
    split, out, state = (scratch_path(spark, name) for name in ("events", "latest", "latest-state"))
    events = data.table(spark, folder, "events")
    events.repartition(12, F.xxhash64("event_id")).write.parquet(split)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(split)
    task_events.stream_latest(data.task_log_of(stream), out, state, fanout=3).awaitTermination()
    return task_events.read_latest(spark, out).select(*SHORT)


def _windows(spark, out):
    return task_events.read_window_counts(spark, out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "status", "events", "closed",
    )


def stream_windows(spark, folder):
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "windows-state")
    log = data.task_log_of(_stream(spark, folder, "events"))
    task_events.stream_window_counts(log, out, state).awaitTermination()
    return _windows(spark, out)


def stream_windows_batches(spark, folder):
    """The same from four files that come one a batch, in no order of time."""
    split, out, state = (scratch_path(spark, name) for name in ("events", "windows", "windows-state"))
    events = data.table(spark, folder, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(split)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(split)
    task_events.stream_window_counts(data.task_log_of(stream), out, state).awaitTermination()
    return _windows(spark, out)


def _streamed_entries(docs):
    """Every line of streamed documents as an entry. The lines carry no arrays."""
    lines = docs.select(
        data.class_of(F.col("doc_id")).alias("class_fqn"), "lang", F.col("source").alias("file"),
        text.rows_of(F.transform(text.split_lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("ln")))).alias("r"),
    )
    return lines.select(
        "class_fqn", data.signature(F.col("r.ln"), F.col("lang"), F.col("r.line")).alias("method"), "file", "r.line",
        F.lit("@RpcService").alias("annotation"),
    )


def _run_queue(spark, docs, done, out, state):
    queue.stream_queue(_streamed_entries(docs), done, out, state, F.lit(5).cast("bigint")).awaitTermination()
    return spark.read.parquet(out).select("task_id", "class_fqn", "method", "file", "line", "status", "scope")


def stream_queue(spark, folder):
    done = data.done_index(spark, folder)
    return _run_queue(spark, _stream(spark, folder, "documents"), done, scratch_path(spark, "queue"), scratch_path(spark, "queue-state"))


def stream_queue_batches(spark, folder):
    """The same from four batches, each of which brings half of the documents
    of the one before again. A batch is all that came since the run before, so
    it has any number of files."""
    split, out, state = (scratch_path(spark, label) for label in ("documents", "queue", "queue-state"))
    docs, done = data.table(spark, folder, "documents"), data.done_index(spark, folder)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int")
    again = F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0, F.least(part + 1, F.lit(3)))
    for batch in range(4):
        come = docs.where((part == batch) | F.coalesce(again == batch, F.lit(False)))
        come.write.mode("append").parquet(split)
        found = _run_queue(spark, spark.readStream.schema(docs.schema).parquet(split), done, out, state)
    return found


def _documents(spark, folder):
    stub = generate.stub_documents(data.entries(spark, folder), WORDS)
    return stub.select(
        F.concat("entry_id", F.lit("#"), F.col("line").cast("string")).alias("task_id"), "class_fqn",
        F.lit("METHOD").alias("scope"), "module", "markdown",
        F.when(F.col("line") == 1, F.lit("{}")).otherwise(" ").alias("json"),
    )


def written_documents(spark, folder):
    """Documents written to a table and read back."""
    out = scratch_path(spark, "outputs")
    outputs.write_outputs(_documents(spark, folder), out, OutputOptions(write_doc=False, group_by_module=True))
    return outputs.read_outputs(spark, out).select("task_id", "kind", "module", "path", "content")


def written_index(spark, folder):
    """The index of what was just written holds every entry."""
    out = scratch_path(spark, "outputs")
    outputs.write_outputs(_documents(spark, folder), out)
    return index.output_index(outputs.list_output_table(spark, out))


def written_log(spark, folder):
    """The log written, read, nested and flattened again."""
    out = scratch_path(spark, "log")
    task_log.append_log(data.task_log(spark, folder), out)
    log = task_log.read_log(spark, out)
    back = task_log.to_log(task_log.to_tasks(log))
    return back.select("task_id", "class_fqn", "method", "created_at", "status", "progress", "message", "scope", "error_type", "error_message", "attempt")


def written_runs(spark, folder):
    """Three runs: the second writes some paths again, the third has names in
    pairs that become the same path."""
    out = scratch_path(spark, "outputs")
    docs, options = _documents(spark, folder), OutputOptions(write_doc=False)
    outputs.write_outputs(docs, out, options)
    again = docs.where("json = '{}'").withColumn("markdown", F.concat(F.lit("again "), "class_fqn")).drop("json")
    outputs.write_outputs(again, out, options)
    twins = docs.where("json = '{}'").drop("json").withColumn("created_at", F.explode(F.array(F.lit(1), F.lit(2))))
    name = F.concat("class_fqn", F.when(F.col("created_at") == 1, "#f()").otherwise("#f[]"), F.lit("#9"))
    twins = twins.withColumn("task_id", name).withColumn("markdown", F.concat(F.lit("twin "), F.col("created_at").cast("string")))
    outputs.write_outputs(twins, out, options)
    return outputs.read_outputs(spark, out).select("task_id", "kind", "path", "content", "run")


def written_paths(spark, folder):
    """What the manifest says of the runs: paths that count as done, with sizes."""
    out = scratch_path(spark, "outputs")
    outputs.write_outputs(_documents(spark, folder), out, OutputOptions(group_by_module=True))
    done = outputs.list_output_table(spark, out)
    return outputs.written_paths(spark, out).join(done, "path", "left_semi").select("path", "kind", "module", "size", "run")


def appended_log(spark, folder):
    """The log in two appends, the second of which comes twice: the log itself
    numbers its rows, by append, time, attempt and state."""
    out = scratch_path(spark, "log")
    log = data.task_log(spark, folder)
    odd = F.col("seq") % 2 == 1
    for part, key in ((log.where(~odd), "even"), (log.where(odd), "odd"), (log.where(odd), "odd")):
        task_log.append_log(part.drop("seq"), out, key)
    found = task_log.read_log(spark, out)
    rows = found.groupBy("task_id").agg(F.count("*").alias("updates"), F.count_distinct("seq").alias("numbers"))
    return tasks.latest(found).join(rows, "task_id").select("task_id", "status", "message", "attempt", "updates", "numbers")


def named_apart(spark, folder):
    """Every line as an entry of two modules: each has a task of its own name."""
    one = data.entries(spark, folder)
    two = one.withColumn("module", F.lit("copy")).withColumn("file", F.concat(F.lit("copy/"), "file"))
    made = tasks.new_tasks(one.unionByName(two), F.lit(5).cast("bigint"))
    return tasks.name_apart(made).select("task_id", "class_fqn", "method", "module", "file", "created_at")


def twin_contexts(spark, folder):
    """Entries of classes that two modules declare: each has a text of its own,
    with one method named and shown. Texts are given up to their source."""
    t = data.stored(spark, folder, "classes", "methods", "annotations", "type_refs", "calls", "source_files")
    copy = lambda df, column: df.withColumn(column, F.concat(F.lit("copy/"), column))
    in_copy = lambda df, column: df.unionByName(copy(df, column).withColumn("module", F.lit("copy")))
    t["classes"], t["source_files"] = in_copy(t["classes"], "file"), in_copy(t["source_files"], "path")
    t["methods"] = t["methods"].unionByName(copy(t["methods"], "file"))
    options = Options(annotation=data.SETTING, context=CONTEXT)
    queued = materialize(jobs.scan(t, data.done_files(spark, folder), options, F.lit(5).cast("bigint")), "queued")
    asked = jobs.requests(t, queued, options).select("task_id", "module", "file", "context")
    named = F.regexp_count("context", F.lit("# Entry Method"))
    shown = F.regexp_count("context", F.lit("# Method Source"))
    head = F.substring_index("context", "# Method Source", 1)
    return asked.select("task_id", "module", "file", named.alias("named"), shown.alias("shown"), head.alias("head"))


def whole_job(spark, folder):
    """From scan to documents: requests, replies of which some fail, documents,
    log, a second try of what failed, and a second scan that finds nothing."""
    t = data.stored(spark, folder, "classes", "methods", "annotations", "type_refs", "calls", "source_files")
    options = Options(annotation=data.SETTING, context=CONTEXT, output=OutputOptions(write_doc=False))
    done, table, log = data.done_files(spark, folder), scratch_path(spark, "outputs"), scratch_path(spark, "log")
    todo = materialize(jobs.scan(t, done, options, F.lit(5).cast("bigint")), "queued")
    task_log.append_log(todo, log, "scan")
    for attempt in range(2):
        asked = jobs.requests(t, todo, options)
        fails = F.lit(attempt == 0) & (F.length("task_id") % 5 == 0)
        content = F.concat(F.lit("```md\n# "), "task_id", F.lit("\n```"))
        body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
        replies = asked.select(
            "task_id", F.when(fails, 503).otherwise(200).alias("http_status"), F.when(fails, "busy").otherwise(body).alias("body"),
            F.lit(100).cast("bigint").alias("failed_at"),
        )
        good, bad = jobs.documents(materialize(replies, "replies"), todo, options)
        outputs.write_outputs(good, table, options.output)
        task_log.append_log(good, log, f"good {attempt}")
        task_log.append_log(bad, log, f"bad {attempt}")
        todo = materialize(jobs.requeue(bad, F.lit(1600)), "queued")
        task_log.append_log(todo, log, f"again {attempt}")
    left = jobs.scan(t, outputs.list_output_table(spark, table).union(done), options).count()
    states = tasks.latest(task_log.read_log(spark, log))
    written = outputs.read_outputs(spark, table).select("task_id", "path", "content")
    return states.join(written, "task_id", "left").select(
        "task_id", "status", "attempt", "message", F.col("md_path"), "path", "content", F.lit(left).alias("left_to_do")
    )


def written_symbols(spark, folder):
    """Symbol tables written and read: rows, and rows that came back the same."""
    out = scratch_path(spark, "symbols")
    made = {
        "classes": data.classes(spark, folder), "methods": data.methods(spark, folder),
        "annotations": data.annotations(spark, folder), "type_refs": data.type_refs(spark, folder),
        "calls": data.calls(spark, folder), "source_files": data.source_files(spark, folder),
    }
    symbols.write_symbols(made, out)
    found = symbols.read_symbols(spark, out)
    counts = []
    for name, df in found.items():
        columns = [F.col(f.name).cast(f.dataType) for f in symbols.TABLES[name]]
        hashed = lambda rows, side: rows.select(F.xxhash64(*columns).alias("h"), F.lit(side).alias("side"))
        both = hashed(made[name], 1).unionByName(hashed(df, -1)).groupBy("h").agg(F.sum("side").alias("d"), F.count_if(F.col("side") < 0).alias("n"))
        same = F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).cast("bigint").alias("same")
        counts.append(both.agg(F.sum("n").cast("bigint").alias("n"), same).select(F.lit(name).alias("name"), "n", "same"))
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


WINDOWS_SQL = sql(LOG, """
        w AS (SELECT time_bucket(INTERVAL '1 hour', updated_at) AS window_start, status, count(*) AS events FROM log GROUP BY 1, 2)""", body="""
        SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, status, events,
               window_start + INTERVAL '1 hour' <= (SELECT max(updated_at) FROM log) - INTERVAL '1 hour' AS closed FROM w""")

# Documents whose methods have no document yet.
NOT_DONE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"
QUEUE_SQL = sql(SRC, body=f"""
        SELECT id || '#5' AS task_id, class_fqn, sig AS method, source AS file, k AS line, 'QUEUED' AS status, 'METHOD' AS scope
        FROM m JOIN (SELECT doc_id, source FROM src) USING (doc_id)
        WHERE {NOT_DONE}""")
LATEST_SQL = sql(LOG, body="""
        SELECT task_id, class_fqn, method, status, progress, message, scope, error_type, error_message, attempt, seq FROM last""")

QUERIES = {
    "latest_tasks": (latest_tasks, sql(LOG, body="""
        SELECT task_id, class_fqn, method, status, progress, message, scope, error_type, error_message, attempt, seq,
               created_at, file, line, annotation FROM last""")),
    "history_limit": (history_limit, sql(LOG, body="SELECT task_id, status, seq FROM last ORDER BY seq DESC LIMIT 50")),
    "queue_status": (queue_status, sql(LOG, body="""
        SELECT count(*) FILTER (status = 'QUEUED') AS queued_count, count(*) FILTER (status = 'RUNNING') AS running_count,
               count(*) FILTER (status = 'PARTIAL') AS partial_count, count(*) FILTER (status = 'SUCCEEDED') AS succeeded_count,
               count(*) FILTER (status = 'FAILED') AS failed_count, count(*) FILTER (status = 'CANCELLED') AS cancelled_count,
               count(*) AS total_count, count(*) FILTER (status = 'RUNNING') > 0 AS running,
               least(10, count(*) FILTER (status = 'QUEUED')) AS queue_size,
               greatest(0, count(*) FILTER (status = 'QUEUED') - 10) AS backlog_size,
               10 - least(10, count(*) FILTER (status = 'QUEUED')) AS queue_remaining_capacity FROM last""")),
    "status_counts": (status_counts, sql(LOG, body="SELECT status, count(*) AS tasks FROM last GROUP BY status")),
    "search_tasks": (search_tasks, sql(LOG, body="""
        SELECT task_id, message, seq FROM log WHERE status = 'FAILED' AND task_id LIKE 'u1%'""")),
    "search_messages": (search_messages, sql(LOG, body="""
        SELECT task_id, message, seq FROM log WHERE message ILIKE '%"k": 9%'""")),
    "sorted_tasks": (sorted_tasks, """
        SELECT 't' || lpad(o_orderkey::VARCHAR, 9, '0') AS task_id, 'C' || o_custkey AS class_fqn, o_orderpriority AS method,
               CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'QUEUED' ELSE 'PARTIAL' END AS status FROM orders"""),
    "task_page": (task_page, """
        SELECT row_number() OVER (ORDER BY rank, task_id) AS row_no, task_id, status FROM (
          SELECT 't' || lpad(o_orderkey::VARCHAR, 9, '0') AS task_id,
                 CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'QUEUED' ELSE 'PARTIAL' END AS status,
                 CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 1 ELSE 3 END AS rank FROM orders)
        ORDER BY row_no LIMIT 20 OFFSET 60"""),
    "last_task_page": (last_task_page, """
        SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey DESC) AS row_no,
               't' || lpad(o_orderkey::VARCHAR, 9, '0') AS task_id, o_custkey AS created_at FROM orders
        QUALIFY row_no > ((SELECT count(*) FROM orders) - 1) // 20 * 20"""),
    "deep_task_page": (deep_task_page, """
        SELECT row_number() OVER (ORDER BY lower('C' || o_custkey || '#' || o_orderpriority) DESC, o_orderkey DESC) AS row_no,
               't' || lpad(o_orderkey::VARCHAR, 9, '0') AS task_id, 'C' || o_custkey AS class_fqn FROM orders
        ORDER BY row_no LIMIT 20 OFFSET 740"""),
    "retry_decisions": (retry_decisions, sql(LOG, body="""
        SELECT task_id, seq, CASE WHEN attempt + 1 < 3 THEN 'PARTIAL' ELSE 'FAILED' END AS status,
               CASE WHEN attempt + 1 < 3 THEN attempt + 1 ELSE attempt END AS attempt,
               CASE WHEN attempt + 1 < 3 THEN created_at + 1500 ELSE -1 END AS due_at, error_message
        FROM log WHERE status = 'FAILED'""")),
    "recover_pending": (recover_pending, sql(LOG, body="""
        SELECT task_id, class_fqn, method, 'QUEUED' AS status, 0.0::DOUBLE AS progress, 'Auto-resume' AS message, scope,
               error_type, error_message, attempt, seq FROM last WHERE status IN ('QUEUED', 'RUNNING', 'PARTIAL')""")),
    "rerun_failed": (rerun_failed, sql(LOG, body="""
        SELECT class_fqn || '#' || method || '#77' AS task_id, class_fqn, method, scope, 'QUEUED' AS status,
               77::BIGINT AS created_at, 0 AS attempt FROM last WHERE status = 'FAILED'""")),
    "rerun_timeouts": (rerun_timeouts, sql(LOG, body="""
        SELECT class_fqn || '#' || method || '#78' AS task_id, class_fqn, method, scope, 'QUEUED' AS status,
               78::BIGINT AS created_at, 0 AS attempt FROM last
        WHERE status = 'FAILED' AND (error_type ILIKE '%timeout%' OR error_message ILIKE '%timed out%')""")),
    "rerun_by_ids": (rerun_by_ids, sql(LOG, body="""
        SELECT task_id, status, seq FROM last WHERE task_id IN (SELECT 'u' || (c_custkey * 3) FROM customer)""")),
    "queued_tasks": (queued_tasks, sql(SRC, body="""
        SELECT id || '#' || (k * 1000) AS task_id, class_fqn, sig AS method, 'METHOD' AS scope, 'QUEUED' AS status,
               (k * 1000)::BIGINT AS created_at FROM m""")),
    "stream_latest": (stream_latest, LATEST_SQL),
    "stream_latest_batches": (stream_latest_batches, LATEST_SQL),
    "stream_windows": (stream_windows, WINDOWS_SQL),
    "stream_windows_batches": (stream_windows_batches, WINDOWS_SQL),
    "stream_queue": (stream_queue, QUEUE_SQL),
    "stream_queue_batches": (stream_queue_batches, QUEUE_SQL),
    "written_documents": (written_documents, sql(SRC, f"""
        d AS (SELECT id || '#' || k AS task_id, lang AS module, k, regexp_replace(id || '#' || k, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
                     replace(class_fqn, '.', '/') AS folder, {STUB_SQL} AS content FROM m)""", body="""
        SELECT task_id, 'md' AS kind, module, 'md/' || module || '/' || folder || '/' || safe || '.md' AS path, content FROM d
        UNION ALL SELECT task_id, 'json', module, 'method-docs/' || safe || '.json', '{}' FROM d WHERE k = 1""")),
    "written_index": (written_index, sql(SRC, body="""
        SELECT DISTINCT class_fqn, rtrim(regexp_replace(sig, '[^a-zA-Z0-9._-]', '_', 'g'), '_') AS method_key, name AS base_name, 'METHOD' AS kind FROM m""")),
    "written_log": (written_log, sql(LOG, body="""
        SELECT task_id, class_fqn, method, created_at, status, progress, message, scope, error_type, error_message, attempt FROM log""")),
    "written_symbols": (written_symbols, sql(SRC, body="""
        SELECT name, n, n AS same FROM (
        SELECT 'classes' AS name, count(*) AS n FROM src UNION ALL SELECT 'methods', count(*) FROM m
        UNION ALL SELECT 'annotations', (SELECT count(*) FROM m WHERE word <> '') + (SELECT count(*) FROM src)
        UNION ALL SELECT 'type_refs', (SELECT count(*) FROM m) + 3 * (SELECT count(*) FROM src)
        UNION ALL SELECT 'calls', (SELECT count(*) FROM m WHERE k < n) + (SELECT count(*) FROM m)
        UNION ALL SELECT 'source_files', count(*) FROM src)""")),
    "written_runs": (written_runs, sql(SRC, f"""
        d AS (SELECT id || '#' || k AS task_id, k, class_fqn, regexp_replace(id || '#' || k, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
                     replace(class_fqn, '.', '/') AS folder, {STUB_SQL} AS content FROM m)""", body="""
        SELECT task_id, 'md' AS kind, 'md/' || folder || '/' || safe || '.md' AS path,
               CASE WHEN k = 1 THEN 'again ' || class_fqn ELSE content END AS content, (k = 1)::BIGINT AS run FROM d
        UNION ALL SELECT task_id, 'json', 'method-docs/' || safe || '.json', '{}', 0 FROM d WHERE k = 1
        UNION ALL SELECT class_fqn || '#f[]#9', 'md', 'md/' || folder || '/' || class_fqn || '_f___9.md', 'twin 2', 2 FROM d WHERE k = 1""")),
    "written_paths": (written_paths, sql(SRC, f"""
        d AS (SELECT lang, regexp_replace(id || '#' || k, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
                     replace(class_fqn, '.', '/') AS folder, length({STUB_SQL}) AS size FROM m)""", body="""
        SELECT 'md/' || lang || '/' || folder || '/' || safe || '.md' AS path, 'md' AS kind, lang AS module, size, 0::BIGINT AS run FROM d
        UNION ALL SELECT 'docs/' || lang || '/' || folder || '/' || safe || '.doc', 'docs', lang, size, 0 FROM d""")),
    "appended_log": (appended_log, sql(LOG, body="""
        SELECT task_id, status, message, attempt, updates, updates AS numbers FROM (
          SELECT *, count(*) OVER (PARTITION BY task_id) AS updates, row_number() OVER (PARTITION BY task_id ORDER BY seq % 2 DESC, updated_at DESC,
            attempt DESC, CASE status WHEN 'QUEUED' THEN 1 WHEN 'RUNNING' THEN 2 WHEN 'PARTIAL' THEN 3 WHEN 'SUCCEEDED' THEN 4 ELSE 5 END DESC) AS r FROM log)
        WHERE r = 1""")),
    "named_apart": (named_apart, sql(SRC, body="""
        SELECT id || '#' || ms AS task_id, class_fqn, sig AS method, module, file, ms AS created_at FROM (
          SELECT id, class_fqn, sig, lang AS module, file, 6::BIGINT AS ms FROM m
          UNION ALL SELECT id, class_fqn, sig, 'copy', 'copy/' || file, 5 FROM m)""")),
    "twin_contexts": (twin_contexts, sql(SRC, TAGGED, body=f"""
        SELECT id || '#' || ms AS task_id, module, file, 1 AS named, 1 AS shown, '# Entry Method' || chr(10) || id || chr(10) || chr(10) AS head FROM (
          SELECT id, doc_id, lang AS module, file, 6::BIGINT AS ms FROM tagged
          UNION ALL SELECT id, doc_id, 'copy', 'copy/' || file, 5 FROM tagged)
        WHERE {NOT_DONE}""")),
    "whole_job": (whole_job, sql(SRC, TAGGED, body=f"""
        SELECT id || '#5' AS task_id, 'SUCCEEDED' AS status, (length(id || '#5') % 5 = 0)::INTEGER AS attempt, 'Done' AS message,
               path AS md_path, path, '# ' || id || '#5' AS content, 0::BIGINT AS left_to_do FROM (
          SELECT *, 'md/' || replace(class_fqn, '.', '/') || '/' || regexp_replace(id || '#5', '[^a-zA-Z0-9._-]', '_', 'g') || '.md' AS path FROM tagged)
        WHERE {NOT_DONE}""")),
}
