"""Queries on entry selection, categories, keys, indexes and resume lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeloom.functions import text
from scribeloom.operators import index, locate, resume, select
from scribeloom.options import OutputOptions, PrefixLists
from workload import data
from workload.data import SRC, TAGGED, sql

WORDS = PrefixLists(create=("Th", "e"), read=("a", "q", "la"), update=("d", "re"), delete=("s",))
WANTED = ("CREATE", "READ", "OTHER")
CATEGORY = """CASE WHEN starts_with(lower(name), 'th') OR starts_with(lower(name), 'e') THEN 'CREATE'
  WHEN starts_with(lower(name), 'a') OR starts_with(lower(name), 'q') OR starts_with(lower(name), 'la') THEN 'READ'
  WHEN starts_with(lower(name), 'd') OR starts_with(lower(name), 're') THEN 'UPDATE'
  WHEN starts_with(lower(name), 's') THEN 'DELETE' ELSE 'OTHER' END"""
SAFE = "regexp_replace({}, '[^a-zA-Z0-9._-]', '_', 'g')"


def categorized(spark, folder):
    entries = data.entries(spark, folder)
    return select.add_category(entries, text.base_name(F.col("method")), WORDS)


def category_counts(spark, folder):
    return select.category_counts(categorized(spark, folder), WANTED)


def kept_entries(spark, folder):
    return select.keep_categories(categorized(spark, folder), WANTED).select("class_fqn", "method", "category")


def default_categories(spark, folder):
    names = data.table(spark, folder, "events").select("event_id", F.concat("event_type", F.lit("_x")).alias("name"))
    parts = data.table(spark, folder, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("name"))
    return select.add_category(names.unionByName(parts), "name").groupBy("category", "name").agg(F.count("*").alias("n"))


def symbol_entries(spark, folder, per_class=False):
    return select.select_entries(
        data.classes(spark, folder), data.methods(spark, folder), data.annotations(spark, folder),
        data.CLASS_SETTING if per_class else data.SETTING, per_class,
    )


def entry_select(spark, folder):
    return symbol_entries(spark, folder).select("class_fqn", "method", "file", "line", "matched_annotation", "module")


def entry_select_per_class(spark, folder):
    return symbol_entries(spark, folder, True).select("class_fqn", "method", "file", "line", "matched_annotation", "module")


def page_hosts(spark, folder):
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    pages = data.table(spark, folder, "pages").select(
        "page_id", host.alias("qualified_name"), F.substring_index(host, ".", -1).alias("simple_name")
    )
    return pages.where(select.annotation_matches("example.com, @example.org;blog.tionsh.example.net")).select(
        "page_id", "qualified_name"
    )


def _modules(spark, folder):
    return data.documents(spark, folder).select("doc_id", F.col("lang").alias("module"), "n_chars")


def module_scope(spark, folder):
    return select.in_module(_modules(spark, folder), "fr")


def module_scope_unknown(spark, folder):
    return select.in_module(_modules(spark, folder), "no-such-module")


def exclude_patterns(spark, folder):
    part = data.table(spark, folder, "part").select("p_partkey", "p_name")
    return select.exclude_paths(part, F.col("p_name"), ["red .*", ".* ring", "old"])


def target_types(spark, folder):
    marked = select.mark_targets(data.classes(spark, folder), data.annotations(spark, folder))
    return marked.where("is_target").select("class_fqn", "simple_name", "package", "is_enum")


def class_entries(spark, folder):
    docs = data.documents(spark, folder)
    entries = docs.select(
        F.concat(F.lit("com.acme."), "source").alias("class_fqn"),
        F.concat(F.lit("read("), "lang", F.lit(")")).alias("method"),
        "file", F.col("n_chars").alias("line"), F.lit(0).alias("class_ord"), F.col("doc_id").alias("method_ord"),
    )
    return select.class_entries(entries).select("class_fqn", "method", "file", "line", "scope")


def output_names(spark, folder):
    """Names in all known shapes: per method, per class, and page addresses."""
    odd = data.table(spark, folder, "pages").select(
        F.concat(F.lit("docs/"), text.safe_name(F.col("url")), F.lit(".doc")).alias("path")
    )
    plain = data.documents(spark, folder).select(
        F.concat(F.lit("docs/com.acme."), "source", F.lit(".D"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    )
    return data.done_files(spark, folder).unionByName(odd).unionByName(plain)


def output_index(spark, folder):
    return index.output_index(output_names(spark, folder))


def unusable_outputs(spark, folder):
    return index.unusable_outputs(output_names(spark, folder))


def safe_paths(spark, folder):
    docs = data.documents(spark, folder).select(
        F.concat(F.lit("com.acme$"), "source", F.lit("."), F.substring_index("text", " ", 1)).alias("class_fqn"),
        F.concat(F.lit("read("), "lang", F.lit(")")).alias("method"), F.col("n_chars").alias("created_at"),
        F.concat(F.lit("mod "), "lang").alias("module"), "doc_id",
        F.when(F.col("lang") == "de", "CLASS").otherwise("METHOD").alias("scope"),
    )
    docs = docs.withColumn("task_id", text.task_id(F.col("class_fqn"), F.col("method"), F.col("created_at")))
    options = OutputOptions(group_by_module=True)
    path = lambda root, ext: text.relative_path(
        root, F.col("task_id"), ext, F.col("class_fqn"), F.col("scope"), F.col("module"), options
    )
    return docs.select(
        "doc_id", "task_id", path("md", "md").alias("md_path"), path("docs", "doc").alias("doc_path"),
        text.bundle_path(F.col("task_id")).alias("ctx_path"), text.method_key(F.col("method")).alias("method_key"),
    )


def skip_methods(spark, folder):
    done = data.done_index(spark, folder)
    return index.skip_done_methods(data.entries(spark, folder), done).select("class_fqn", "method")


def skip_classes(spark, folder):
    done = data.done_index(spark, folder)
    return index.skip_done_classes(select.class_entries(data.entries(spark, folder)), done).select(
        "class_fqn", "method", "file", "line"
    )


def never_indexed(spark, folder):
    hosts = data.table(spark, folder, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://[^/]*/|[?#].*$", "").alias("class_fqn")
    )
    return index.never_indexed(hosts)


def resume_lines(spark, folder):
    """One line per method, in all the shapes a list may hold."""
    rows = data.method_rows(spark, folder)
    shape = F.col("k") % 6
    line = (
        F.when(shape == 0, F.concat_ws("#", "class_fqn", "method_sig"))
        .when(shape == 1, F.concat(F.lit("  "), "class_fqn", F.lit("#"), "name", F.lit("#x.md\t")))
        .when(shape == 2, F.concat("class_fqn", F.lit("#class")))
        .when(shape == 3, F.concat("class_fqn", F.lit("_"), "name", F.lit("_"), "lang", F.lit("_L__"), F.col("n").cast("string"), F.lit(".md")))
        .when(shape == 4, F.concat(F.lit("# "), "class_fqn"))
        .otherwise(F.concat("class_fqn", F.lit(".txt")))
    )
    return rows.select((F.col("doc_id") * 100000 + F.col("k")).alias("line_no"), line.alias("line"))


def resume_parse(spark, folder):
    return resume.parse_lines(resume_lines(spark, folder))


def resume_list(spark, folder):
    found = resume.resolve(resume_parse(spark, folder), data.entries(spark, folder))
    return found.select("class_fqn", "method", "scope", "file", "line", "resume_line")


def resume_remaining(spark, folder):
    found = resume.resolve(resume_parse(spark, folder), data.entries(spark, folder))
    good = data.method_rows(spark, folder).join(data.table(spark, folder, "labels").where("quality = 1"), "doc_id")
    history = good.select(
        "class_fqn", F.when(F.col("lang") == "en", F.col("method_sig")).otherwise("CLASS").alias("method"),
        F.when(F.col("lang") == "en", "METHOD").otherwise("CLASS").alias("scope"), F.lit("SUCCEEDED").alias("status"),
    )
    return resume.skip_succeeded(found, history).select("class_fqn", "method", "scope")


def locate_methods(spark, folder):
    found = locate.locate_methods(
        data.entries(spark, folder), data.classes(spark, folder), data.methods(spark, folder)
    )
    return found.select("entry_id", "file", "class_fqn", "method_sig", "start_line", "end_line")


def numbered_lines(spark, folder):
    return locate.numbered_lines(data.source_files(spark, folder))


def anchor_lines(spark, folder):
    anchored = locate.anchors(data.entries(spark, folder))
    return locate.anchor_lines(anchored, locate.file_lines(data.source_files(spark, folder)), one_each=True)


NAMES = r"""
names AS (
  SELECT 'docs/' || lang || '/' || regexp_replace(id || '#' || n, '[^a-zA-Z0-9._-]', '_', 'g') || '.md' AS path
  FROM m JOIN labels USING (doc_id) WHERE quality = 1
  UNION ALL SELECT 'md/' || class_fqn || '_Class__' || n || '.MD' FROM m JOIN labels USING (doc_id) WHERE toxic = 1 AND k = 1
  UNION ALL SELECT 'docs/' || regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') || '.doc' FROM pages
  UNION ALL SELECT 'docs/com.acme.' || source || '.D' || doc_id || '.md' FROM documents),
stems AS (
  SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '_+[0-9]*$', '') AS s FROM names),
keys AS (
  SELECT path, CASE WHEN strpos(s, '_') <= 1 THEN s ELSE substr(s, 1, strpos(s, '_') - 1) END AS class_fqn,
         CASE WHEN strpos(s, '_') > 1 THEN substr(s, strpos(s, '_') + 1) END AS tail FROM stems),
judged AS (
  SELECT *, tail IS NULL OR lower(tail) = 'class' AS whole,
         contains(class_fqn, '.') AND (tail IS NULL OR lower(tail) = 'class' OR trim(split_part(tail, '_', 1)) <> '') AS usable FROM keys)"""

RESUME = r"""
resume_lines AS (
  SELECT doc_id * 100000 + k AS line_no, CASE k % 6
      WHEN 0 THEN class_fqn || '#' || sig WHEN 1 THEN class_fqn || '#' || name WHEN 2 THEN class_fqn || '#class'
      WHEN 3 THEN class_fqn || '_' || name || '_' || lang WHEN 5 THEN class_fqn END AS line, k % 6 AS shape,
      class_fqn, name, sig FROM m),
parsed AS (
  SELECT line_no, class_fqn, CASE shape WHEN 0 THEN sig WHEN 1 THEN name WHEN 2 THEN 'class' WHEN 3 THEN name ELSE 'CLASS' END AS method_key
  FROM resume_lines WHERE shape <> 4)"""

RESOLVED = r"""
resolved AS (
  SELECT m.class_fqn, m.sig AS method, 'METHOD' AS scope, m.file, m.k AS line, min(p.line_no) AS resume_line
  FROM m JOIN parsed p ON p.class_fqn = m.class_fqn AND (p.method_key = m.sig OR p.method_key = m.name)
  WHERE lower(p.method_key) <> 'class' GROUP BY ALL
  UNION ALL
  SELECT m.class_fqn, 'CLASS', 'CLASS', m.file, m.k, (SELECT min(line_no) FROM parsed p WHERE p.class_fqn = m.class_fqn AND lower(method_key) = 'class')
  FROM m WHERE m.k = 1 AND EXISTS (SELECT 1 FROM parsed p WHERE p.class_fqn = m.class_fqn AND lower(method_key) = 'class'))"""

QUERIES = {
    "category_counts": (category_counts, sql(SRC, body=f"""
        SELECT {CATEGORY} AS category, count(*) FILTER ({CATEGORY} IN ('CREATE', 'READ', 'OTHER')) AS kept,
               count(*) FILTER ({CATEGORY} NOT IN ('CREATE', 'READ', 'OTHER')) AS dropped FROM m GROUP BY 1""")),
    "kept_entries": (kept_entries, sql(SRC, body=f"""
        SELECT class_fqn, sig AS method, {CATEGORY} AS category FROM m WHERE {CATEGORY} IN ('CREATE', 'READ', 'OTHER')""")),
    "default_categories": (default_categories, """
        SELECT CASE WHEN regexp_matches(name, '^(create|add|insert|save|new)') THEN 'CREATE'
                    WHEN regexp_matches(name, '^(get|query|list|find|select|count|load)') THEN 'READ'
                    WHEN regexp_matches(name, '^(update|set|modify|patch|enable|disable)') THEN 'UPDATE'
                    WHEN regexp_matches(name, '^(delete|remove|del|clear)') THEN 'DELETE' ELSE 'OTHER' END AS category,
               name, count(*) AS n
        FROM (SELECT event_type || '_x' AS name FROM events UNION ALL SELECT p_name FROM part) GROUP BY ALL"""),
    "entry_select": (entry_select, sql(SRC, TAGGED, body="""
        SELECT class_fqn, sig AS method, file, k AS line, tag AS matched_annotation, lang AS module FROM tagged""")),
    "entry_select_per_class": (entry_select_per_class, sql(SRC, body="""
        SELECT class_fqn, sig AS method, file, k AS line,
               CASE WHEN word = 'the' THEN 'org.lib.the' ELSE 'org.lang.' || lang END AS matched_annotation, lang AS module
        FROM m WHERE word = 'the' OR lang IN ('de', 'fr')""")),
    "page_hosts": (page_hosts, r"""
        SELECT page_id, h AS qualified_name
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS h FROM pages)
        WHERE h IN ('example.com', 'example.org', 'blog.tionsh.example.net') OR ends_with(h, '.example.com')
           OR ends_with(h, '.example.org') OR ends_with(h, '.blog.tionsh.example.net')"""),
    "module_scope": (module_scope, "SELECT doc_id, lang AS module, n_chars FROM documents WHERE lang = 'fr'"),
    "module_scope_unknown": (module_scope_unknown, "SELECT doc_id, lang AS module, n_chars FROM documents"),
    "exclude_patterns": (exclude_patterns, """
        SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, 'red .*|.* ring|old')"""),
    "target_types": (target_types, """
        SELECT 'com.acme.D' || doc_id AS class_fqn,
               'D' || doc_id || CASE WHEN quality = 1 THEN 'Vo' ELSE '' END AS simple_name,
               'com.acme.' || lang || CASE WHEN toxic = 1 THEN '.entity' ELSE '' END AS package, n_chars < 300 AS is_enum
        FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 300 OR quality = 1 OR toxic = 1"""),
    "class_entries": (class_entries, sql(SRC, body="""
        SELECT 'com.acme.' || source AS class_fqn, 'CLASS' AS method, arg_min(file, file) AS file,
               arg_min(n_chars, file) AS line, 'CLASS' AS scope FROM src GROUP BY source""")),
    "output_index": (output_index, sql(SRC, NAMES, body="""
        SELECT DISTINCT class_fqn, CASE WHEN NOT whole THEN tail END AS method_key,
               CASE WHEN NOT whole THEN split_part(tail, '_', 1) END AS base_name,
               CASE WHEN whole THEN 'CLASS' ELSE 'METHOD' END AS kind FROM judged WHERE usable""")),
    "unusable_outputs": (unusable_outputs, sql(SRC, NAMES, body="SELECT path FROM judged WHERE NOT usable")),
    "safe_paths": (safe_paths, sql(r"""
        t AS (SELECT doc_id, lang, 'com.acme$' || source || '.' || split_part(text, ' ', 1) AS c, n_chars FROM documents),
        p AS (SELECT *, c || '#read(' || lang || ')#' || n_chars AS id,
                array_to_string(list_transform(list_filter(string_split(replace(c, '$', '.'), '.'),
                  lambda x: NOT regexp_full_match(x, '[\p{Z}\t\n\x0B\f\r]*')),
                  lambda x: regexp_replace(x, '[^a-zA-Z0-9_-]', '_', 'g')), '/') AS folder FROM t),
        f AS (SELECT *, regexp_replace(id, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
                'mod_' || lang || '/' || CASE WHEN lang = 'de' THEN '' ELSE folder || '/' END AS dir FROM p)""", body="""
        SELECT doc_id, id AS task_id, 'md/' || dir || safe || '.md' AS md_path, 'docs/' || dir || safe || '.doc' AS doc_path,
               'context-bundles/' || safe || '.txt' AS ctx_path, 'read_' || lang AS method_key FROM f""")),
    "skip_methods": (skip_methods, sql(SRC, body="""
        SELECT class_fqn, sig AS method FROM m
        WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = m.doc_id AND b.quality = 1)""")),
    "skip_classes": (skip_classes, sql(SRC, body="""
        SELECT class_fqn, 'CLASS' AS method, file, k AS line FROM m
        WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = m.doc_id AND b.toxic = 1)""")),
    "never_indexed": (never_indexed, r"""
        SELECT * FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*/|[?#].*$', '', 'g') AS class_fqn FROM pages)
        WHERE contains(class_fqn, '_') OR NOT contains(class_fqn, '.')"""),
    "resume_parse": (resume_parse, sql(SRC, RESUME, body="SELECT line_no, class_fqn, method_key FROM parsed")),
    "resume_list": (resume_list, sql(SRC, RESUME, RESOLVED, body="SELECT * FROM resolved")),
    "resume_remaining": (resume_remaining, sql(SRC, RESUME, RESOLVED, body="""
        SELECT r.class_fqn, r.method, r.scope FROM resolved r JOIN src s USING (class_fqn)
        WHERE NOT (s.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND (r.scope = 'METHOD') = (s.lang = 'en'))""")),
    "locate_methods": (locate_methods, sql(SRC, body="""
        SELECT e.id AS entry_id, e.file, e.class_fqn, arg_min(x.sig, x.k) AS method_sig,
               min(x.k) AS start_line, min(x.k) + 1 AS end_line
        FROM m e JOIN m x ON x.doc_id = e.doc_id AND (e.k BETWEEN x.k AND x.k + 1 OR x.name = e.name) GROUP BY ALL""")),
    "numbered_lines": (numbered_lines, sql(SRC, body="SELECT file, k AS line_no, ln AS text FROM rows")),
    "anchor_lines": (anchor_lines, sql(SRC, body="""
        SELECT e.id AS entry_id, e.file, x.k AS line_no, x.ln AS text
        FROM m e JOIN rows x ON x.doc_id = e.doc_id AND x.k BETWEEN e.k - 2 AND e.k + 2""")),
}
