"""Documents as they are written and found again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom import schemas
from scribeloom.functions import text
from scribeloom.operators.index import OUTPUT_FOLDERS, counts_as_output
from scribeloom.options import OutputOptions
from scribeloom.scale import materialize
from scribeloom.sources import segments


def list_output_files(spark: SparkSession, base: str) -> DataFrame:
    """Document files below a project folder, as paths from that folder on.

    Only paths are read; contents stay where they are. This lists folders on
    the driver: it is for documents that other tools left as single files. Documents
    written here are found by `list_output_table`, from the manifest.
    """
    found = None
    for folder in OUTPUT_FOLDERS:
        try:
            files = (
                spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .load(f"{base}/{folder}").select("path")
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        inner = F.substring_index(F.col("path"), f"{base.rstrip('/')}/{folder}/", -1)
        rows = files.select(F.concat(F.lit(f"{folder}/"), inner).alias("path"))
        rows = rows.where(counts_as_output(F.col("path")))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schemas.OUTPUT_FILES) if found is None else found


PATHS = "path string, kind string, module string, size bigint, run bigint, part string"


def written_paths(spark: SparkSession, table: str) -> DataFrame:
    """Every path of every committed run, with its size and the folder that
    holds it, from the manifest of the table."""
    return segments.read(spark, f"{table}/_paths", PATHS)


def list_output_table(spark: SparkSession, table: str) -> DataFrame:
    """Paths of the documents in an output table that count as done. Neither
    folders nor documents are looked at."""
    rows = written_paths(spark, table).select("path")
    return rows.where(counts_as_output(F.col("path"))).distinct()


def output_rows(documents: DataFrame, options: OutputOptions = OutputOptions()) -> DataFrame:
    """One row per file to write: Markdown, document, JSON if there is any, and
    the context text if there is one.

    documents: task_id, class_fqn, scope, module, markdown [, json, context,
    created_at, which is kept].
    """
    kept = ["created_at"] if "created_at" in documents.columns else []
    task, cls, scope, module = (F.col(c) for c in ("task_id", "class_fqn", "scope", "module"))

    def rel(root: str, ext: str):
        return text.relative_path(root, task, ext, cls, scope, module, options)

    def file(kind: str, path, content):
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), content.alias("content"))

    files = []
    if options.write_markdown:
        files.append(file("md", rel("md", "md"), F.col("markdown")))
    if options.write_doc:
        files.append(file("docs", rel("docs", "doc"), F.col("markdown")))
    if "json" in documents.columns:
        has_json = ~text.is_blank(F.col("json"))
        files.append(F.when(has_json, file("json", text.json_path(task), F.col("json"))))
    if "context" in documents.columns:
        files.append(file("context", text.bundle_path(task), F.col("context")))
    if not files:
        files = [F.lit(None).cast("struct<kind:string,path:string,content:string>")]
    return (
        documents.select("task_id", "module", *kept, text.rows_of(F.array(*files)).alias("f"))
        .where(F.col("f").isNotNull() & F.col("f.content").isNotNull())
        .select("task_id", F.coalesce("module", F.lit("none")).alias("module"), "f.*", *kept)
    )


OUTPUT_TABLE = "task_id string, path string, content string, run bigint, part string, kind string, module string"
# Characters of content that one file should hold about.
FILE_CHARS = 64 << 20


def runs(spark: SparkSession, table: str) -> list[int]:
    """The runs that a table holds, ascending, from its manifest."""
    return sorted(s.first for s in segments.manifest(spark, f"{table}/_paths").segments)


def write_outputs(
    documents: DataFrame, table: str, options: OutputOptions = OutputOptions(), run: int | None = None,
    repeat: bool = False,
) -> int:
    """Write documents as rows of path and content, in folders by kind and
    module, and return the run.

    The documents are computed once. A run can be seen when its paths are in the
    manifest, whole or not at all. Runs are numbered upwards: a path written
    again by a later run replaces the older one for readers. Without a number
    the next free one is taken; a run that exists is refused, unless the caller
    asks to repeat it, which replaces its own rows. Names that become the same
    path give one row, that of the task created last.
    """
    spark = documents.sparkSession
    manifest = segments.manifest(spark, f"{table}/_paths")
    known = [s.first for s in manifest.segments]
    run = run if run is not None else max(known, default=-1) + 1
    if run in known and not repeat:
        raise ValueError(f"run {run} exists; say repeat=True to replace it")
    rows = output_rows(documents, options)
    order = [F.col("created_at"), F.col("task_id")] if "created_at" in rows.columns else [F.col("task_id")]
    kept = ("task_id", "module", "kind", "content")
    rows = rows.groupBy("path").agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r")).select("path", "r.*")
    rows = materialize(rows.withColumn("run", F.lit(run).cast("bigint")), "outputs")
    # Files by kind and module, in pieces of a bounded size, not one per task.
    # A task sorts the pieces it gets, so there are two tasks for each piece.
    n_pieces = F.greatest(F.ceil(F.col("n") / FILE_CHARS), F.lit(1)).cast("int").alias("_pieces")
    sizes = rows.groupBy("kind", "module").agg(F.sum(F.length("content")).alias("n"))
    sizes = materialize(sizes.select("kind", "module", n_pieces), "sizes")
    tasks = 2 * (sizes.agg(F.sum("_pieces")).first()[0] or 1)
    dealt = rows.join(sizes, ["kind", "module"])
    dealt = dealt.repartition(tasks, "kind", "module", F.pmod(F.xxhash64("path"), "_pieces")).drop("_pieces")
    columns = ("task_id", "path", "content", "run", "kind", "module")
    part = segments.write_segment(dealt.select(*columns), table, ("kind", "module"), "part=")
    paths = rows.select("path", "kind", "module", F.length("content").cast("bigint").alias("size"), "run", F.lit(part).alias("part"))
    if not segments.add(paths, f"{table}/_paths", run, part, replace=repeat):
        raise ValueError(f"run {run} was written by another writer meanwhile")
    return run


def read_outputs(spark: SparkSession, table: str) -> DataFrame:
    """The last content written to each path. Which rows are superseded comes
    from the manifest; contents are not shuffled unless many are."""
    parts = [s.key for s in segments.manifest(spark, f"{table}/_paths").segments]
    if not parts:
        return spark.createDataFrame([], OUTPUT_TABLE)
    rows = spark.read.schema(OUTPUT_TABLE).option("basePath", table).parquet(*[f"{table}/{p}" for p in parts])
    last = F.max("run").over(W.partitionBy("path"))
    old = written_paths(spark, table).select("path", "run").withColumn("last", last).where("run < last").select("path", "run")
    return rows.join(old, ["path", "run"], "left_anti")
