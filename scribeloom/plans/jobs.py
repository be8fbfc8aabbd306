"""The three whole jobs: scan to queue, queue to documents, list to queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scribeloom.functions import text
from scribeloom.operators import bundle, index, prompt, reply, request, resume, select, tasks
from scribeloom.options import Options
from scribeloom.scale import materialize


def scan(
    symbols: dict[str, DataFrame], output_files: DataFrame, options: Options = Options(),
    created_at: Column | None = None, observation: Observation | None = None,
) -> DataFrame:
    """Queued tasks for the entries that have no document yet."""
    classes = select.in_module(symbols["classes"], options.module)  # before any join
    entries = select.select_entries(
        classes, symbols["methods"], symbols["annotations"], options.annotation, options.per_class
    )
    entries = select.add_category(entries, text.base_name(F.col("method")), options.prefixes)
    entries = select.keep_categories(entries, options.categories, observation)
    # Stored, so that Spark knows its size and broadcasts it if it is small.
    done = materialize(index.output_index(output_files), "index")
    if options.per_class:
        todo = index.skip_done_classes(select.class_entries(entries), done)
    else:
        todo = index.skip_done_methods(entries, done)
    return tasks.name_apart(tasks.new_tasks(todo, created_at))


def requests(symbols: dict[str, DataFrame], queued: DataFrame, options: Options = Options()) -> DataFrame:
    """Request rows of queued tasks: task_id, context, prompt, provider, model, body.

    A context text belongs to an entry: two tasks of one entry share it, and
    entries of equal names in two modules have one each.
    """
    queued = queued.withColumn("entry_id", tasks.entry_of(queued))
    marked = select.mark_targets(symbols["classes"], symbols["annotations"], options.context)
    entries = queued.drop("task_id").dropDuplicates(["entry_id"])
    by_method = bundle.method_bundles(
        entries.where("scope = 'METHOD'"), symbols["classes"], symbols["methods"], marked,
        symbols["type_refs"], symbols["calls"], symbols["source_files"], options.context,
    )
    by_class = bundle.class_bundles(
        entries.where("scope = 'CLASS'"), symbols["classes"], symbols["methods"], marked,
        symbols["type_refs"], symbols["source_files"], options.context,
    )
    contexts = by_method.unionByName(by_class).select("entry_id", F.col("text").alias("context"))
    prompts = prompt.render_prompts(queued.join(contexts, "entry_id").drop("entry_id"), options.prompt, options.prefixes)
    return request.request_rows(prompts, options.request)


def documents(replies: DataFrame, queued: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Finished tasks with their clean documents, and the next state of the others.

    The first can be given to `write_outputs` and to `append_log`, the second to
    `append_log`; `requeue` takes back those whose pause is over.
    replies: task_id, http_status, body, failed_at.
    """
    read = reply.read_replies(replies)
    good = reply.clean_replies(read.where(F.col("content").isNotNull())).select("task_id", "markdown")
    bad = read.where(F.col("content").isNull()).select("task_id", "failed_at", "error_type", "error_message")
    old = [c for c in queued.columns if c not in ("error_type", "error_message")]
    return (
        tasks.succeed(queued.join(good, "task_id"), options.output),
        tasks.decide_retry(queued.select(*old).join(bad, "task_id"), options.retry),
    )


def requeue(waiting: DataFrame, now: Column) -> DataFrame:
    """Tasks that wait for another attempt and are due, as queued tasks."""
    return tasks.requeue_due(waiting, now).drop("failed_at", "due_at")


def resume_list(
    lines: DataFrame, symbols: dict[str, DataFrame], history: DataFrame, options: Options = Options(),
    skip_succeeded: bool = True, created_at: Column | None = None,
) -> DataFrame:
    """Queued tasks for a list of names. The scan covers all modules and categories."""
    entries = select.select_entries(
        symbols["classes"], symbols["methods"], symbols["annotations"], options.annotation, options.per_class
    )
    found = resume.resolve(resume.parse_lines(lines), entries)
    if skip_succeeded:
        found = resume.skip_succeeded(found, history)
    return tasks.name_apart(tasks.new_tasks(found, created_at))
