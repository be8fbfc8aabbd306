"""The task log: latest state, search, order, pages, retry and recovery."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom.functions import fixed, text
from scribeloom.options import Options, OutputOptions, RetryOptions

# A page is looked up among this many rows; more are narrowed first, by bounds
# from a sample, in ranges.
NARROW_TO = 20_000
SAMPLE = 1024
RANGES = 32


def new_tasks(entries: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Queued tasks for entries; entries with a scope keep it.

    The time is fixed when the frame is built, so that its task ids are the
    same each time it is computed.
    """
    created = F.lit(time.time_ns() // 1_000_000).cast("bigint") if created_at is None else created_at
    scope = F.col("scope") if "scope" in entries.columns else F.lit("METHOD")
    return entries.select(
        text.task_id(F.col("class_fqn"), F.col("method"), created).alias("task_id"),
        "class_fqn", "method", "file", "line", "annotation",
        created.cast("bigint").alias("created_at"),
        F.lit("QUEUED").alias("status"),
        F.lit(0.0).alias("progress"),
        F.lit(None).cast("string").alias("message"),
        scope.alias("scope"),
        F.lit(0).alias("attempt"),
        *([F.col("module")] if "module" in entries.columns else []),  # where its documents will lie
    )


def entry_of(tasks: DataFrame) -> Column:
    module = F.col("module") if "module" in tasks.columns else F.lit(None).cast("string")
    return text.entry_id(F.col("class_fqn"), F.col("method"), F.col("file"), module)


def name_collisions(tasks: DataFrame) -> DataFrame:
    """Task ids that several entries share, a row each: task_id, entry_id, and
    the place among them, by module and file."""
    module = F.col("module") if "module" in tasks.columns else F.lit(None).cast("string")
    each = tasks.select("task_id", entry_of(tasks).alias("entry_id"), module.alias("module"), "file")
    # Counted before the shuffle; a name that one entry has goes no further.
    shared = each.groupBy("task_id").agg(F.min("entry_id").alias("a"), F.max("entry_id").alias("b")).where("a < b").select("task_id")
    place = F.row_number().over(W.partitionBy("task_id").orderBy("module", "file", "entry_id")) - 1
    return each.join(shared, "task_id", "left_semi").distinct().select("task_id", "entry_id", place.alias("place"))


def name_apart(tasks: DataFrame) -> DataFrame:
    """Tasks whose ids no other entry has: entries that share one are created a
    millisecond after each other, so that neither documents nor replies meet."""
    places = name_collisions(tasks)
    created = F.col("created_at") + F.coalesce("place", F.lit(0))
    moved = tasks.withColumn("entry_id", entry_of(tasks)).join(places, ["task_id", "entry_id"], "left").withColumn("created_at", created)
    return moved.withColumn("task_id", text.task_id(F.col("class_fqn"), F.col("method"), F.col("created_at"))).select(*tasks.columns)


def latest(log: DataFrame) -> DataFrame:
    """Last row of each task by `seq`; combined before the shuffle. A row
    without `seq` comes before all others of its task."""
    rest = [c for c in log.columns if c not in ("task_id", "seq")]
    place = F.coalesce("seq", F.lit(-(1 << 63)))
    return (
        log.groupBy("task_id")
        .agg(F.max_by(F.struct(*rest), place).alias("s"), F.max("seq").alias("seq"))
        .select("task_id", "s.*", "seq")
    )


def history(log: DataFrame, limit: int = Options().history_limit) -> DataFrame:
    """The tasks updated last."""
    return latest(log).orderBy(F.desc("seq"), F.desc("task_id")).limit(limit)


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"))


def queue_status(tasks: DataFrame, options: Options = Options()) -> DataFrame:
    """One row on the state of the queue."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = tasks.agg(
        *[n(s).alias(f"{s.lower()}_count") for s in fixed.STATUSES], F.count("*").alias("total_count")
    )
    waiting = F.col("queued_count")
    in_queue = F.least(waiting, F.lit(options.queue_size).cast("bigint"))
    return counts.select(
        "*",
        (F.col("running_count") > 0).alias("running"),
        F.lit(options.max_concurrent).alias("max_concurrent"),
        in_queue.alias("queue_size"),
        (waiting - in_queue).alias("backlog_size"),
        (F.lit(options.queue_size).cast("bigint") - in_queue).alias("queue_remaining_capacity"),
        F.lit(options.requests_per_second).alias("requests_per_second"),
    )


def search(tasks: DataFrame, status: str = "ALL", query: str = "") -> DataFrame:
    """Tasks of a status whose id, names, message or summary hold the text."""
    if status != "ALL":
        tasks = tasks.where(F.col("status") == status)
    if query.strip():
        needle = F.lit(query.lower())
        hit = F.lit(False)
        for name in ("task_id", "class_fqn", "method", "message", "cg_summary"):
            if name in tasks.columns:
                hit = hit | F.coalesce(F.contains(F.lower(name), needle), F.lit(False))
        tasks = tasks.where(hit)
    return tasks


def status_rank(status: Column) -> Column:
    out = None
    for name, rank in fixed.STATUS_RANK.items():
        out = F.when(status == name, rank) if out is None else out.when(status == name, rank)
    return out.otherwise(fixed.UNKNOWN_RANK)


def sort_key(by: str) -> Column:
    keys = {
        "CREATED_AT": lambda: F.col("created_at"),
        "ENTRY": lambda: F.lower(F.concat_ws("#", "class_fqn", "method")),
        "STATUS": lambda: status_rank(F.col("status")),
        "PROGRESS": lambda: F.col("progress"),
    }
    return keys[by]()


def order_columns(by: str = "CREATED_AT", ascending: bool = False, tie: str = "task_id") -> list[Column]:
    """Sort key and tie-break; a descending order turns both."""
    columns = [sort_key(by), F.col(tie)]
    return [c.asc() if ascending else c.desc() for c in columns]


def sort_tasks(tasks: DataFrame, by: str = "CREATED_AT", ascending: bool = False) -> DataFrame:
    return tasks.orderBy(*order_columns(by, ascending))


def page_info(tasks: DataFrame, page_size: int, index: int) -> tuple[int, int, int]:
    """Rows, pages, and the page index clamped to them."""
    total = tasks.count()
    pages = -(-total // max(1, page_size))
    return total, pages, min(max(index, 0), max(pages - 1, 0))


def page(
    tasks: DataFrame, index: int, page_size: int = Options().page_size, by: str = "CREATED_AT",
    ascending: bool = False, narrow_to: int = NARROW_TO,
) -> DataFrame:
    """One page of the sorted tasks, with the number of each row in the whole.

    The page is found by rank: only sort keys and ids are read, bounds from a
    sample cut them into ranges, the sizes of the ranges tell which one holds
    the page, and that one is cut again, until few rows are left. Nothing is
    sorted or written whole, and a page costs the same wherever it lies. Rows
    of equal key and id stay together, and are told apart by their other columns
    in no set order.
    """
    size = max(1, page_size)
    total, _, index = page_info(tasks, size, index)
    offset = index * size
    rows = min(size, total - offset)
    if rows <= 0:
        return tasks.limit(0).withColumn("row_no", F.lit(None).cast("bigint"))
    place = F.struct(sort_key(by).alias("key"), F.col("task_id").alias("id"))
    least = offset if ascending else total - offset - rows  # rank of the page's least row
    # A row each from the array, so that filters on places do not compute sort keys again.
    keys, before = _narrow(tasks.select(text.rows_of(F.array(place)).alias("place")), least, rows, total, narrow_to)
    wanted = keys.orderBy("place").offset(least - before).limit(rows)
    first, last = wanted.agg(F.min("place"), F.max("place")).first()
    before += keys.where(F.col("place") < _literal(first, keys)).count()
    held = tasks.where((place >= _literal(first, keys)) & (place <= _literal(last, keys)))
    # No more rows than the page has, but for rows that equal its ends.
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(place)).cast("bigint") + before
    numbered = held.withColumn("row_no", number).where((F.col("row_no") > least) & (F.col("row_no") <= least + rows))
    return numbered if ascending else numbered.withColumn("row_no", total + 1 - F.col("row_no"))


def _literal(value: Row, keys: DataFrame) -> Column:
    fields = keys.schema["place"].dataType.fields
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, fields, strict=True)])


def _bounds(keys: DataFrame) -> list[Row]:
    """Ascending places that cut the keys into ranges of about equal size, from
    the rows of least hash, which are a sample that a rerun repeats."""
    found = keys.orderBy(F.xxhash64("place.key", "place.id"), "place").limit(SAMPLE).agg(F.sort_array(F.collect_set("place"))).first()[0]
    step = max(1, len(found) // RANGES)
    return found[step // 2 :: step]


def _narrow(keys: DataFrame, least: int, rows: int, total: int, narrow_to: int) -> tuple[DataFrame, int]:
    """The keys around ranks least to least + rows, and the number of keys
    before them."""
    left, before = total, 0
    while left > max(narrow_to, 2 * rows):
        bounds = _bounds(keys)
        ends = F.array(*[_literal(b, keys) for b in bounds])
        range_ = F.size(F.filter(ends, lambda end: end <= F.col("place")))
        sizes = {r["range"]: r["count"] for r in keys.groupBy(range_.alias("range")).count().collect()}  # one row a range
        start, low, high, skipped, inside = before, None, None, before, 0
        for n in range(len(bounds) + 1):
            end = start + sizes.get(n, 0)
            if start < least + rows and end > least:
                low, skipped = (n, start) if low is None else (low, skipped)
                high, inside = n, inside + sizes[n]
            start = end
        if inside == left:  # places that cannot be told apart any further
            break
        if low > 0:
            keys = keys.where(F.col("place") >= _literal(bounds[low - 1], keys))
        if high < len(bounds):
            keys = keys.where(F.col("place") < _literal(bounds[high], keys))
        left, before = inside, skipped
    return keys, before


def shown_columns(tasks: DataFrame) -> DataFrame:
    """The columns of a task list."""
    return tasks.select(
        "row_no",
        F.concat_ws("#", "class_fqn", "method").alias("entry"),
        "status",
        F.format_string("%.0f%%", F.col("progress") * 100).alias("progress"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("json_path", F.lit("")).alias("json"),
        F.coalesce("md_path", F.lit("")).alias("markdown"),
    )


def decide_retry(failures: DataFrame, retry: RetryOptions = RetryOptions()) -> DataFrame:
    """Next state of failed runs: PARTIAL with a due time while attempts are
    left, else FAILED. failures: attempt, failed_at (epoch ms), error columns."""
    again = F.lit(retry.enabled) & (F.col("attempt") + 1 < retry.max_attempts)
    return failures.withColumns({
        "status": F.when(again, "PARTIAL").otherwise("FAILED"),
        "attempt": F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")),
        "due_at": F.when(again, F.col("failed_at") + F.lit(retry.backoff_ms).cast("bigint")),
        "error_message": F.coalesce("error_message", F.lit("error")),
    })


def succeed(done: DataFrame, options: OutputOptions = OutputOptions()) -> DataFrame:
    """Tasks whose document is there: finished, with the paths it is written to.

    done: task_id, class_fqn, scope [, module, json, context].
    """
    task, module = F.col("task_id"), F.col("module") if "module" in done.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")

    def rel(root: str, ext: str) -> Column:
        return text.relative_path(root, task, ext, F.col("class_fqn"), F.col("scope"), module, options)

    has_json = ~text.is_blank(F.col("json")) if "json" in done.columns else F.lit(False)
    has_context = F.col("context").isNotNull() if "context" in done.columns else F.lit(False)
    return done.withColumns({
        "status": F.lit("SUCCEEDED"), "progress": F.lit(1.0), "message": F.lit(fixed.DONE_MESSAGE),
        "md_path": rel("md", "md") if options.write_markdown else none,
        "doc_path": rel("docs", "doc") if options.write_doc else none,
        "json_path": F.when(has_json, text.json_path(task)), "ctx_path": F.when(has_context, text.bundle_path(task)),
        "module": module,
    })


def requeue_due(tasks: DataFrame, now: Column) -> DataFrame:
    """PARTIAL tasks whose due time has come, back in the queue."""
    return tasks.where((F.col("status") == "PARTIAL") & (F.col("due_at") <= now)).withColumn(
        "status", F.lit("QUEUED")
    )


def recover_pending(log: DataFrame) -> DataFrame:
    """Unfinished tasks put back in the queue; their errors are kept."""
    return latest(log).where(F.col("status").isin(*fixed.PENDING)).withColumns({
        "status": F.lit("QUEUED"),
        "progress": F.lit(0.0),
        "message": F.lit(fixed.RESUME_MESSAGE),
    })


def failed(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") == "FAILED")


def timed_out(tasks: DataFrame) -> DataFrame:
    # What a timeout looks like in an error.
    by_type = F.contains(F.lower("error_type"), F.lit("timeout"))
    by_message = F.contains(F.lower("error_message"), F.lit("timed out"))
    return failed(tasks).where(F.coalesce(by_type, F.lit(False)) | F.coalesce(by_message, F.lit(False)))


def by_ids(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi")


def run_again(tasks: DataFrame, created_at: Column | None = None) -> DataFrame:
    """New queued tasks for the entries of old ones, in their old scope."""
    return new_tasks(tasks, created_at)
