"""Queries on closures, context texts, prompts, requests and replies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from scribeloom import schemas
from scribeloom.functions import fixed, templates, text
from scribeloom.operators import bundle, generate, graph, index, locate, prompt, reply, request, select
from scribeloom.options import ContextOptions, PromptOptions
from scribeloom.scale import scratch_path
from scribeloom.sources import segments
from workload import data
from workload.data import CALL_EDGES, CLASSES, SRC, TAGGED, TYPE_EDGES, literal, sql
from workload.selection import CATEGORY, WANTED, WORDS

LIMIT = 2000
LARGE = 20_000
WHOLE = 1 << 30  # no text is as long
CONTEXT = ContextOptions(type_depth=2, called_depth=3, max_chars=LIMIT)
CUSTOM = "Method ${ENTRY_METHOD} (${ENTRY_METHOD_BASE}) of ${ENTRY_CLASS_FQN}: ${HTTP_METHOD}\n${CONTEXT}\n-- ${ENTRY_METHOD}"
REVIEW_OWN = "Review ${ENTRY_CLASS_FQN}:\n${CONTEXT}"


def _roots(spark, folder):
    return data.method_rows(spark, folder).select("class_fqn", "method_sig")


def _marked(tables):
    return select.mark_targets(tables["classes"], tables["annotations"])


def called_closure(spark, folder):
    return graph.called_methods(data.calls(spark, folder), _roots(spark, folder), 4).select("root", "node", "depth")


def supply_closure(spark, folder):
    """Customers reach orders, orders parts, parts the suppliers of returned lines."""
    item = data.table(spark, folder, "lineitem")
    orders = data.table(spark, folder, "orders")
    number = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))

    def call(rows, caller, caller_id, callee, callee_id, inside=F.lit(True)):
        return rows.select(
            F.lit(caller).alias("caller_class"), number("n", caller_id).alias("caller_sig"), F.lit(0).alias("call_ord"),
            F.lit(callee).alias("callee_class"), number("n", callee_id).alias("callee_sig"), inside.alias("callee_in_project"),
        )

    calls = (
        call(orders, "customer", "o_custkey", "order", "o_orderkey")
        .unionByName(call(item, "order", "l_orderkey", "part", "l_partkey"))
        .unionByName(call(item, "part", "l_partkey", "supplier", "l_suppkey", F.col("l_returnflag") == "R"))
    )
    roots = data.table(spark, folder, "customer").select(
        F.lit("customer").alias("class_fqn"), number("n", "c_custkey").alias("method_sig")
    )
    return graph.called_methods(calls, roots, 4).select("root", "node", "depth")


def type_closure(spark, folder):
    t = data.stored(spark, folder, "classes", "annotations", "type_refs")
    return graph.method_types(t["type_refs"], _marked(t), 2).select("root", "node", "level")


def class_types(spark, folder):
    t = data.stored(spark, folder, "classes", "annotations", "type_refs")
    public = select.with_signature(data.methods(spark, folder)).where("is_public")
    return graph.class_types(public, t["type_refs"], _marked(t), 2).select("class_fqn", "type_fqn")


def graph_size(spark, folder):
    edges = data.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )
    return graph.graph_summary(graph.graph_size(edges), 2)


def numbered_documents(spark, folder, limit=LIMIT):
    return bundle.numbered_files(data.source_files(spark, folder), limit)


def source_bundles(spark, folder, limit=LIMIT):
    """All documents of a source in one text: a key with any number of parts."""
    docs = data.documents(spark, folder).select("source", "doc_id", F.concat("text", F.lit("\n")).alias("text"))
    return bundle.cut_parts(docs, limit, key="source", order=("doc_id",), many=True)


def method_bundles(spark, folder, context=CONTEXT):
    t = data.stored(spark, folder, "classes", "methods", "annotations", "type_refs", "calls")
    entries = select.select_entries(t["classes"], t["methods"], t["annotations"], data.SETTING).withColumn(
        "entry_id", F.concat_ws("#", "class_fqn", "method")
    )
    found = bundle.method_bundles(
        entries, t["classes"], t["methods"], _marked(t), t["type_refs"], t["calls"],
        data.source_files(spark, folder), context,
    )
    return found.select("entry_id", "text")


def class_bundles(spark, folder, context=CONTEXT):
    t = data.stored(spark, folder, "classes", "methods", "annotations", "type_refs")
    entries = t["classes"].select(F.col("class_fqn").alias("entry_id"), "class_fqn")
    found = bundle.class_bundles(
        entries, t["classes"], t["methods"], _marked(t), t["type_refs"], data.source_files(spark, folder), context
    )
    return found.select("entry_id", "text")


def at_limit(query, limit):
    """A query on context texts at another limit."""
    return lambda spark, folder: query(spark, folder, replace(CONTEXT, max_chars=limit))


def _doc_entries(spark, folder):
    """A document as an entry: named by its first word, with its text as context.

    The word is exploded, so that filters on it do not search the text again.
    """
    word = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.lit("m"))
    docs = data.documents(spark, folder).select("doc_id", "lang", "text", "n_chars", text.rows_of(F.array(word)).alias("word"))
    return docs.select(
        "doc_id", "lang", F.concat(F.lit("com.acme.D"), F.col("doc_id").cast("string")).alias("class_fqn"),
        F.concat("word", F.lit("("), "lang", F.lit(",L1)")).alias("method"), F.col("text").alias("context"), "n_chars",
    )


def prompts_default(spark, folder):
    return prompt.render_prompts(_doc_entries(spark, folder)).select("doc_id", "prompt")


def prompts_custom(spark, folder):
    options = PromptOptions(custom_enabled=True, custom_template=CUSTOM)
    return prompt.render_prompts(_doc_entries(spark, folder), options, WORDS).select("doc_id", "prompt")


def prompts_by_name(spark, folder):
    own = spark.createDataFrame(
        [(templates.REVIEW_NAME, REVIEW_OWN), ("mine", CUSTOM), ("blank", " \n")], schemas.TEMPLATES
    )
    name = (
        F.when(F.col("lang") == "en", "mine").when(F.col("lang") == "fr", templates.REVIEW_NAME)
        .when(F.col("lang") == "de", "blank").otherwise("no such template")
    )
    entries = _doc_entries(spark, folder).withColumn("template_name", name)
    return prompt.render_by_name(entries, prompt.all_templates(spark, own), WORDS).select("doc_id", "prompt")


def requests(spark, folder):
    setting = F.element_at(F.array(F.lit("OPENAI"), F.lit("DEEPSEEK"), F.lit("OTHER")), F.col("doc_id").cast("int") % 3 + 1)
    endpoint = F.when(F.col("doc_id") % 3 == 2, "http://host:11434/x").otherwise("http://host/v1")
    model = F.when(F.col("lang") == "en", "big-chat").when(F.col("lang") == "fr", 'own "7b"').otherwise("deepseek-reasoner")
    rows = _doc_entries(spark, folder).withColumns(
        {"provider_setting": setting, "endpoint": endpoint, "model": model, "prompt": F.col("context")}
    )
    return request.request_rows(rows).select("doc_id", "provider", "endpoint", "model", "body")


def request_rows(spark, folder):
    """From entries to requests: categories, what is done already, prompt, body."""
    entries = select.add_category(_doc_entries(spark, folder), text.base_name(F.col("method")), WORDS)
    kept = select.keep_categories(entries, WANTED)
    todo = index.skip_done_methods(kept, data.done_index(spark, folder))
    options = PromptOptions(custom_enabled=True, custom_template=CUSTOM)
    rows = request.request_rows(prompt.render_prompts(todo, options, WORDS))
    return rows.select("doc_id", "category", "provider", "model", "prompt", "body")


def replies(spark, folder):
    """Documents as replies in both shapes, as bare text, and as errors."""
    docs = data.documents(spark, folder)
    message = F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("&lt;b> &amp;lt; "), F.col("text")).alias("content"))
    chat = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    plain = F.to_json(F.struct(message.alias("message"), F.lit(True).alias("done")))
    body = F.when(F.col("doc_id") % 3 == 0, chat).when(F.col("doc_id") % 3 == 1, plain).otherwise(F.col("text"))
    status = F.when(F.col("lang") == "fr", 500).when(F.col("lang") == "es", 204).otherwise(200)
    return docs.select(F.col("doc_id").cast("string").alias("task_id"), status.alias("http_status"), body.alias("body"))


def reply_parse(spark, folder):
    read = reply.read_replies(replies(spark, folder))
    return read.select("task_id", "http_status", "content", "error_type", "error_message")


def reply_clean(spark, folder):
    docs = data.documents(spark, folder)
    think = F.lit("< Think >let me\nsee</ THINK ><think>b</think>")
    shape = F.col("doc_id") % 4
    content = (
        F.when(shape == 0, F.concat(think, "text", F.lit("<think>open")))
        .when(shape == 1, F.concat(F.lit("\n```Markdown \n"), "text", F.lit(" \n ```\n")))
        .when(shape == 2, F.concat(think, F.lit("```\r\n"), "text", F.lit("\r\n```"), think))
        .otherwise(F.concat(F.lit("```java\n"), "text", F.lit("\n```")))
    )
    rows = docs.select("doc_id", content.alias("content"))
    return reply.clean_replies(rows).select("doc_id", "markdown")


def stub_documents(spark, folder):
    return generate.stub_documents(data.entries(spark, folder), WORDS).select("entry_id", "markdown")


def generated_documents(spark, folder):
    def answer(body: str) -> str:
        if "%%%" in body:
            raise ValueError("odd text")
        return f"{len(body)} {body.count(' ')}"

    rows = data.documents(spark, folder).select(F.col("doc_id").alias("task_id"), F.col("text").alias("body"))
    return generate.generate(rows, answer, max_concurrent=8)


def generated_in_rounds(spark, folder):
    """Documents as requests in three rounds, then all of them again: equal
    texts are asked once, and the second run asks nothing."""
    def answer(body: str) -> str:
        if "%%%" in body:
            raise ValueError("odd text")
        return f"{len(body)} {body.count(' ')}"

    rows = data.documents(spark, folder).select(F.col("doc_id").alias("task_id"), F.col("text").alias("body"))
    path = scratch_path(spark, "replies")
    generate.generate_in_rounds(rows, answer, path, 3, max_concurrent=8)
    found = generate.generate_in_rounds(rows, answer, path, 3, max_concurrent=8)
    asked = segments.read(spark, path, generate.REPLY_TABLE).count()
    return found.withColumn("asked", F.lit(asked))


TYPE_WALK = r"""
type_walk(root, node, level, path) AS (
  SELECT class_fqn || '#' || sig_of, 'com.acme.D' || length(ln), 0, [1] FROM type_roots
  UNION ALL
  SELECT w.root, e.dst, w.level + 1, list_append(w.path, e.ord) FROM type_walk w JOIN type_edges e ON e.src = w.node WHERE w.level < 2),
type_found AS (
  SELECT root, node, level, min(path) AS path FROM type_walk
  WHERE (root, node, level) IN (SELECT root, node, min(level) FROM type_walk GROUP BY ALL)
    AND node IN (SELECT class_fqn FROM classes WHERE is_target) GROUP BY ALL)"""

# Numbered lines a to b of the array l; lines past the end are empty.
NUMBERED = ("list_aggregate(list_transform(generate_series({a}, {b}), "
            "lambda i: CASE WHEN i < 100000 THEN lpad(i::VARCHAR, 6, ' ') ELSE i::VARCHAR END || ' | ' || coalesce(l[i], '') || chr(10)), 'string_agg', '')")



def cut(limit: int) -> str:
    return f"""
placed AS (
  SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY id ORDER BY s, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM parts),
whole AS (
  SELECT id, string_agg(t, '' ORDER BY s, o) AS t,
         bool_or(chk IS NOT NULL AND {limit} - pre > 0 AND {limit} - pre <= length(t) AND {limit} - pre >= chk
                 AND substr(t, ({limit} - pre)::BIGINT, 1) = chr(10)) AS stops FROM placed GROUP BY id)"""


def cut_select(limit: int, stops: str = "stops") -> str:
    return f"""CASE WHEN length(t) > {limit} THEN left(t, {limit}) || CASE WHEN {stops} THEN '' ELSE chr(10) || '... [truncated]' || chr(10) END ELSE t END"""


METHOD_PARTS = rf"""
found AS (
  SELECT e.id, e.doc_id, min(x.k) AS k0 FROM tagged e
  JOIN m x ON x.doc_id = e.doc_id AND (e.k BETWEEN x.k AND x.k + 1 OR x.name = e.name) GROUP BY ALL),
located AS (SELECT f.id, f.k0, r.ln, r.sig, r.id AS root, r.class_fqn FROM found f JOIN m r ON r.doc_id = f.doc_id AND r.k = f.k0),
type_roots AS (SELECT DISTINCT class_fqn, sig AS sig_of, ln FROM located),
{TYPE_WALK.strip()},
call_walk(root, node, level, path) AS (
  SELECT DISTINCT root, root, 0, []::INTEGER[] FROM located
  UNION ALL
  SELECT w.root, e.dst, w.level + 1, list_append(w.path, e.ord) FROM call_walk w JOIN call_edges e ON e.src = w.node WHERE w.level < 2),
call_found AS (
  SELECT root, node, level, min(path) AS path FROM call_walk
  WHERE (root, node, level) IN (SELECT root, node, min(level) FROM call_walk GROUP BY ALL) AND level > 0 GROUP BY ALL),
type_block AS (
  SELECT class_fqn, '## ' || class_fqn || chr(10) || '// File: ' || file || ' [1-' || end_line || ']' || chr(10) || {NUMBERED.format(a=1, b='end_line')} AS b FROM classes),
call_block AS (
  SELECT m.id, '## ' || m.class_fqn || '#' || m.name || chr(10) || '// File: ' || m.file || ' [' || m.k || '-' || (m.k + 1) || ']' || chr(10) || {NUMBERED.format(a='m.k', b='m.k + 1')} AS b
  FROM m JOIN src USING (doc_id)),
type_items AS (
  SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY f.level, f.path) AS o, b FROM located l JOIN type_found f USING (root) JOIN type_block t ON t.class_fqn = f.node),
call_items AS (
  SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY f.path, f.node) AS o, b FROM located l JOIN call_found f USING (root) JOIN call_block t ON t.id = f.node),
call_parts AS (
  SELECT id, o, CASE WHEN o = 1 THEN chr(10) || '{fixed.CALLED_METHODS}' || chr(10) ELSE '' END || b AS t FROM call_items),
parts AS (
  SELECT id, 0 AS s, 0 AS o, '# Entry Method' || chr(10) || id || chr(10) || chr(10) AS t, NULL::BIGINT AS chk FROM tagged
  UNION ALL
  SELECT f.id, 1, 0, '# Method Source' || chr(10) || {NUMBERED.format(a='k0', b='k0 + 1')}, NULL FROM found f JOIN src USING (doc_id)
  UNION ALL
  SELECT id, 2, 0, chr(10) || '# Callgraph Summary' || chr(10) || '[stub] CG+Slice for ' || id || chr(10) || chr(10) || '# Slices' || chr(10), NULL FROM tagged
  UNION ALL
  SELECT g.id, 3, 0, '## File: ' || g.file || ' [' || greatest(1, k - 2) || '-' || (k + 2) || ']' || chr(10) || {NUMBERED.format(a='greatest(1, g.k - 2)', b='least(g.n, g.k + 2)')} || chr(10), NULL
  FROM tagged g JOIN src USING (doc_id)
  UNION ALL
  SELECT id, 4, o, CASE WHEN o = 1 THEN chr(10) || '{fixed.RELATED_TYPES}' || chr(10) ELSE '' END || b || chr(10), NULL FROM type_items
  UNION ALL
  SELECT id, 5, o, t, length(t) FROM call_parts)"""

CLASS_PARTS = rf"""
public AS (SELECT * FROM m WHERE length(ln) > 100),
type_roots AS (SELECT class_fqn, sig AS sig_of, ln FROM public),
{TYPE_WALK.strip()},
class_found AS (
  SELECT p.class_fqn AS id, f.node, min(list_concat([p.k, f.level], f.path)) AS place FROM type_found f JOIN public p ON p.id = f.root GROUP BY ALL),
items AS (
  SELECT i.id, row_number() OVER (PARTITION BY i.id ORDER BY place, node) AS o,
         '## ' || class_fqn || chr(10) || '// File: ' || file || ' [1-' || end_line || ']' || chr(10) AS h,
         {NUMBERED.format(a=1, b='end_line')} AS b, 10 + length(l[1]) AS first_len
  FROM class_found i JOIN classes c ON c.class_fqn = i.node),
headed AS (SELECT *, CASE WHEN o = 1 THEN chr(10) || '{fixed.RELATED_TYPES}' || chr(10) ELSE '' END || h AS hh FROM items),
parts AS (
  SELECT class_fqn AS id, 0 AS s, 0 AS o, '# Entry Class' || chr(10) || class_fqn || chr(10) || chr(10) AS t, NULL::BIGINT AS chk FROM classes
  UNION ALL
  SELECT class_fqn, 1, 0, '# Class Source' || chr(10) || '// File: ' || file || ' [1-' || end_line || ']' || chr(10) || {NUMBERED.format(a=1, b='end_line')} || chr(10) || '# Public Methods' || chr(10), NULL FROM classes
  UNION ALL
  SELECT class_fqn, 2, k, '- ' || sig || chr(10), NULL FROM public
  UNION ALL
  SELECT id, 3, o, hh || b, length(hh) + first_len FROM headed)"""


def _json(expression: str) -> str:
    return f"to_json({expression})"


def _filled(template: str, cls: str, method: str, base: str, verb: str, context: str) -> str:
    out = literal(template)
    for mark, value in (
        ("ENTRY_CLASS_FQN", cls), ("ENTRY_METHOD", method), ("ENTRY_METHOD_BASE", base), ("HTTP_METHOD", verb), ("CONTEXT", context)
    ):
        out = f"replace({out}, '${{{mark}}}', {value})"
    return out


DOC_ENTRIES = r"""
ent AS (SELECT *, name || '(' || lang || ',L1)' AS method FROM (
  SELECT doc_id, lang, n_chars, text, 'com.acme.D' || doc_id AS class_fqn,
         coalesce(nullif(regexp_extract(text, '[A-Za-z]+'), ''), 'm') AS name FROM documents))"""
VERB = f"CASE {CATEGORY} WHEN 'READ' THEN 'GET' WHEN 'UPDATE' THEN 'PUT' WHEN 'DELETE' THEN 'DELETE' ELSE 'POST' END"
DEFAULT_PROMPT = f"replace({literal(templates.INTERFACE_TEMPLATE)}, '${{CONTEXT}}', text)"
CUSTOM_PROMPT = _filled(CUSTOM, "class_fqn", "method", "name", VERB, "text")
SYSTEM = '{"role":"system","content":' + f'"{fixed.SYSTEM_MESSAGE}"' + "},"


def _body(provider: str, model: str, prompt_text: str) -> str:
    return (
        f"""'{{"model":' || {_json(model)} || ',"messages":[' || CASE WHEN {provider} = 'OLLAMA' THEN '' ELSE {literal(SYSTEM)} END
        || '{{"role":"user","content":' || {_json(prompt_text)} || '}}],"stream":false'
        || CASE {provider} WHEN 'OLLAMA' THEN '' WHEN 'DEEPSEEK' THEN ',"temperature":0.7,"top_p":1' ELSE ',"max_tokens":4096,"temperature":0.7,"top_p":1' END || '}}'"""
    )


STUB_SQL = f"""{literal(fixed.STUB_NAME)} || class_fqn || '.' || name || {literal(fixed.INFERRED)} || chr(10) || {literal(fixed.STUB_NOTE)}
    || chr(10) || {literal(fixed.STUB_VERB)} || ({VERB}) || {literal(fixed.INFERRED)} || chr(10) || {literal(chr(10).join(fixed.STUB_TABLES))}"""
BLANK = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F]+"
CLEAN = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\u003c', '<'), '\\u003e', '>')"

def numbered_sql(limit: int) -> str:
    return sql(SRC, f"""
        t AS (SELECT file, {NUMBERED.format(a=1, b='len(l)')} AS t FROM src)""", body=f"""
        SELECT file, {cut_select(limit, 'false')} AS text FROM t""")


def source_sql(limit: int) -> str:
    return sql("""
        t AS (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)""", body=f"""
        SELECT source, {cut_select(limit, 'false')} AS text FROM t""")


def method_sql(limit: int) -> str:
    return sql(SRC, CLASSES, TAGGED, TYPE_EDGES, CALL_EDGES, METHOD_PARTS, cut(limit), body=f"""
        SELECT id AS entry_id, {cut_select(limit)} AS text FROM whole""", recursive=True)


def class_sql(limit: int) -> str:
    return sql(SRC, CLASSES, TYPE_EDGES, CLASS_PARTS, cut(limit), body=f"""
        SELECT id AS entry_id, {cut_select(limit)} AS text FROM whole""", recursive=True)


QUERIES = {
    "request_rows": (request_rows, sql(SRC, DOC_ENTRIES, f"""
        p AS (SELECT doc_id, {CATEGORY} AS category, {CUSTOM_PROMPT} AS prompt FROM ent
              WHERE {CATEGORY} IN ('CREATE', 'READ', 'OTHER') AND NOT EXISTS (
                SELECT 1 FROM m JOIN labels b ON b.doc_id = m.doc_id AND b.quality = 1
                WHERE m.doc_id = ent.doc_id AND m.sig = ent.method))""", body=f"""
        SELECT doc_id, category, 'OPENAI' AS provider, 'Qwen-32B' AS model, prompt, {_body("'OPENAI'", "'Qwen-32B'", "prompt")} AS body FROM p""")),
    "called_closure": (called_closure, sql(SRC, CALL_EDGES, """
        walk(root, node, depth) AS (
          SELECT id, id, 1 FROM m
          UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN call_edges e ON e.src = w.node WHERE w.depth < 4)""", body="""
        SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node HAVING min(depth) > 1""", recursive=True)),
    "supply_closure": (supply_closure, sql("""
        edges AS (
          SELECT DISTINCT 'customer#n' || o_custkey AS src, 'order#n' || o_orderkey AS dst FROM orders
          UNION SELECT 'order#n' || l_orderkey, 'part#n' || l_partkey FROM lineitem
          UNION SELECT 'part#n' || l_partkey, 'supplier#n' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
        walk(root, node, depth) AS (
          SELECT 'customer#n' || c_custkey, 'customer#n' || c_custkey, 1 FROM customer
          UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 4)""", body="""
        SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node HAVING min(depth) > 1""", recursive=True)),
    "type_closure": (type_closure, sql(SRC, CLASSES, TYPE_EDGES, """
        walk(root, node, level) AS (
          SELECT id, 'com.acme.D' || length(ln), 0 FROM m
          UNION SELECT w.root, e.dst, w.level + 1 FROM walk w JOIN type_edges e ON e.src = w.node WHERE w.level < 2)""", body="""
        SELECT root, node, min(level) AS level FROM walk WHERE node IN (SELECT class_fqn FROM classes WHERE is_target)
        GROUP BY root, node""", recursive=True)),
    "class_types": (class_types, sql(SRC, CLASSES, TYPE_EDGES, """
        walk(root, node, level) AS (
          SELECT class_fqn, 'com.acme.D' || length(ln), 0 FROM m WHERE length(ln) > 100
          UNION SELECT w.root, e.dst, w.level + 1 FROM walk w JOIN type_edges e ON e.src = w.node WHERE w.level < 2)""", body="""
        SELECT DISTINCT root AS class_fqn, node AS type_fqn FROM walk
        WHERE node IN (SELECT class_fqn FROM classes WHERE is_target)""", recursive=True)),
    "graph_size": (graph_size, """
        SELECT '[graph] nodes=' || count(*) || ', classpath=2' AS summary
        FROM (SELECT 'o' || l_orderkey AS x FROM lineitem UNION SELECT 'p' || l_partkey FROM lineitem)"""),
    "numbered_documents": (numbered_documents, numbered_sql(LIMIT)),
    "numbered_documents_whole": (lambda spark, folder: numbered_documents(spark, folder, WHOLE), numbered_sql(WHOLE)),
    "source_bundles": (source_bundles, source_sql(LIMIT)),
    "source_bundles_20k": (lambda spark, folder: source_bundles(spark, folder, LARGE), source_sql(LARGE)),
    "method_bundles": (method_bundles, method_sql(LIMIT)),
    "method_bundles_20k": (at_limit(method_bundles, LARGE), method_sql(LARGE)),
    "method_bundles_whole": (at_limit(method_bundles, WHOLE), method_sql(WHOLE)),
    "class_bundles": (class_bundles, class_sql(LIMIT)),
    "class_bundles_20k": (at_limit(class_bundles, LARGE), class_sql(LARGE)),
    "class_bundles_whole": (at_limit(class_bundles, WHOLE), class_sql(WHOLE)),
    "prompts_default": (prompts_default, f"SELECT doc_id, {DEFAULT_PROMPT} AS prompt FROM documents"),
    "prompts_custom": (prompts_custom, sql(DOC_ENTRIES, body=f"SELECT doc_id, {CUSTOM_PROMPT} AS prompt FROM ent")),
    "prompts_by_name": (prompts_by_name, sql(DOC_ENTRIES, body=f"""
        SELECT doc_id, CASE lang WHEN 'en' THEN {CUSTOM_PROMPT} WHEN 'fr' THEN {_filled(REVIEW_OWN, "class_fqn", "method", "name", VERB, "text")}
          ELSE {DEFAULT_PROMPT} END AS prompt FROM ent""")),
    "requests": (requests, sql("""
        r AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'OPENAI' WHEN 1 THEN 'DEEPSEEK' ELSE 'OLLAMA' END AS provider,
                CASE WHEN doc_id % 3 = 2 THEN 'http://host:11434/x' ELSE 'http://host/v1' END AS endpoint,
                CASE lang WHEN 'en' THEN 'big-chat' WHEN 'fr' THEN CASE WHEN doc_id % 3 = 1 THEN 'deepseek-chat' ELSE 'own "7b"' END ELSE 'deepseek-reasoner' END AS model
              FROM documents)""", body=f"SELECT doc_id, provider, endpoint, model, {_body('provider', 'model', 'text')} AS body FROM r")),
    "reply_parse": (reply_parse, sql("""
        r AS (SELECT doc_id, text, CASE lang WHEN 'fr' THEN 500 WHEN 'es' THEN 204 ELSE 200 END AS st,
                CASE doc_id % 3 WHEN 0 THEN '{"choices":[{"message":{"role":"assistant","content":' || to_json('&lt;b> &amp;lt; ' || text) || '}}]}'
                  WHEN 1 THEN '{"message":{"role":"assistant","content":' || to_json('&lt;b> &amp;lt; ' || text) || '},"done":true}' ELSE text END AS body
              FROM documents)""", body=f"""
        SELECT doc_id::VARCHAR AS task_id, st AS http_status,
               CASE WHEN st < 300 THEN CASE WHEN doc_id % 3 = 2 THEN {CLEAN.format('text')} ELSE '<b> &lt; ' || {CLEAN.format('text')} END END AS content,
               CASE WHEN st >= 300 THEN 'RuntimeException' END AS error_type,
               CASE WHEN st >= 300 THEN 'HTTP ' || st || ' — ' || left(body, 240) END AS error_message FROM r""")),
    "reply_clean": (reply_clean, f"""
        SELECT doc_id, CASE doc_id % 4
          WHEN 0 THEN regexp_replace(text, '^{BLANK}', '') || '<think>open'
          WHEN 1 THEN regexp_replace(text, '{BLANK}$', '')
          WHEN 2 THEN regexp_replace(text, '{BLANK}$', '')
          ELSE '```java' || chr(10) || text || chr(10) || '```' END AS markdown FROM documents"""),
    "stub_documents": (stub_documents, sql(SRC, body=f"SELECT id AS entry_id, {STUB_SQL} AS markdown FROM m")),
    "generated_in_rounds": (generated_in_rounds, """
        SELECT doc_id AS task_id, CASE WHEN contains(text, '%%%') THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               CASE WHEN NOT contains(text, '%%%') THEN length(text) || ' ' || (len(string_split(text, ' ')) - 1) END AS reply,
               CASE WHEN contains(text, '%%%') THEN 'ValueError' END AS error_type,
               CASE WHEN contains(text, '%%%') THEN 'odd text' END AS error_message,
               (SELECT count(DISTINCT text) FROM documents) AS asked FROM documents"""),
    "generated_documents": (generated_documents, """
        SELECT doc_id AS task_id, CASE WHEN contains(text, '%%%') THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               CASE WHEN NOT contains(text, '%%%') THEN length(text) || ' ' || (len(string_split(text, ' ')) - 1) END AS reply,
               CASE WHEN contains(text, '%%%') THEN 'ValueError' END AS error_type,
               CASE WHEN contains(text, '%%%') THEN 'odd text' END AS error_message FROM documents"""),
}
