"""Entry selection, categories, file names, resume lists."""

import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

import project
from scribeloom.functions import fixed, text
from scribeloom.operators import index, resume, select
from scribeloom.options import Options, OutputOptions, PrefixLists, RequestOptions

# File names under docs/ and the keys they stand for.
GOLDEN = [
    ("com.xxx.xxx.xxx.xxx.service.XxxxService_checkEnableBill_String_String__1756819782590.md",
     "com.xxx.xxx.xxx.xxx.service.XxxxService", "checkEnableBill_String_String", "checkEnableBill", "METHOD"),
    ("com.example.demo.UserService_CLASS__123456.md", "com.example.demo.UserService", None, None, "CLASS"),
    ("com.pkg.Service_doIt_Int_String_9999.md", "com.pkg.Service", "doIt_Int_String", "doIt", "METHOD"),
    ("com.demo.AService_process_List_String__123.md", "com.demo.AService", "process_List_String", "process", "METHOD"),
    ("com.demo.AService_log_String__456.md", "com.demo.AService", "log_String", "log", "METHOD"),
    ("com.demo.BService_sum_int___789.md", "com.demo.BService", "sum_int", "sum", "METHOD"),
    ("com.demo.BService_use_Outer.Inner__888.md", "com.demo.BService", "use_Outer.Inner", "use", "METHOD"),
    ("com.demo.Whole.DOC", "com.demo.Whole", None, None, "CLASS"),
    ("com.demo.C_class_1.md", "com.demo.C", None, None, "CLASS"),
    ("com.A1.md", "com.A1", None, None, "CLASS"),
    ("_com.x_9.md", "_com.x", None, None, "CLASS"),
    ("nopackage_run__1.md", None, None, None, None),
    ("com.x.Y__run.md", None, None, None, None),
    ("plain.md", None, None, None, None),
]


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_file_names(spark):
    files = spark.createDataFrame([(f"docs/a/{g[0]}",) for g in GOLDEN], "path string")
    got = {tuple(r) for r in index.output_index(files).select("class_fqn", "method_key", "base_name", "kind").collect()}
    assert got == {g[1:] for g in GOLDEN if g[1]}
    assert {r["path"] for r in index.unusable_outputs(files).collect()} == {f"docs/a/{g[0]}" for g in GOLDEN if not g[1]}


def test_which_files_count(spark):
    paths = ["docs/a.md", "docs/x/a.DOC", "md/a.md", "md/a.doc", "docs/a.txt", "docs/md", "other/a.md", "docs.md"]
    got = column(spark, paths, index.counts_as_output)
    assert got == [True, True, True, False, False, False, False, False]


def test_resume_lines(spark):
    lines = [
        "com.a.B#run", " com.a.B#run(int, x) ", "com.a.B#CLASS", "# comment", "", "   ", "com.a.B#run#123.md",
        "com.xxx.service.XxxxService_checkEnableBill_String_String__1756819782590.md", "com.demo.BService_use_Outer.Inner__888.md",
        "com.a.B", "com.a.B_.md", "Bare", ".x", "com.a.B_run_1.txt.doc.md", "com.a.B_run_1.md.doc", "a#", "#x", "com.q.A# ", "com.a._x",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    got = {r["line_no"]: (r["class_fqn"], r["method_key"]) for r in resume.parse_lines(df).collect()}
    assert got == {
        0: ("com.a.B", "run"), 1: ("com.a.B", "run(int, x)"), 2: ("com.a.B", "CLASS"), 6: ("com.a.B", "run"),
        7: ("com.xxx.service.XxxxService", "checkEnableBill"), 8: ("com.demo.BService_use_Outer.Inner", "CLASS"),
        9: ("com.a.B", "CLASS"), 10: ("com.a.B", "CLASS"), 13: ("com.a.B", "run"), 14: ("com.a.B_run_1.md", "CLASS"),
        17: ("com.q.A# ".strip(), "CLASS"), 18: ("com.a._x", "CLASS"),
    }


def test_resume_resolves_names_overloads_and_classes(spark):
    entries = spark.createDataFrame(
        [("c.A", "get(int)", "f", 3, 0, 1), ("c.A", "get(long)", "f", 5, 0, 2), ("c.A", "put()", "f", 1, 0, 0), ("c.B", "get()", "g", 1, 0, 0)],
        "class_fqn string, method string, file string, line int, class_ord int, method_ord int",
    )
    lines = spark.createDataFrame([(1, "c.A#get"), (2, "c.A#get(int)"), (3, "c.A#class"), (4, "c.A#CLASS"), (5, "c.X#get"), (6, "c.A#get")], "line_no bigint, line string")
    found = resume.resolve(resume.parse_lines(lines), entries)
    got = {(r["class_fqn"], r["method"], r["scope"], r["line"], r["resume_line"]) for r in found.collect()}
    assert got == {("c.A", "get(int)", "METHOD", 3, 1), ("c.A", "get(long)", "METHOD", 5, 1), ("c.A", "CLASS", "CLASS", 1, 3)}
    assert found.count() == 3
    history = spark.createDataFrame(
        [("c.A", "get(int)", "METHOD", "SUCCEEDED"), ("c.A", "CLASS", "METHOD", "SUCCEEDED"), ("c.A", "get(long)", "METHOD", "FAILED")],
        "class_fqn string, method string, scope string, status string",
    )
    left = {(r["method"], r["scope"]) for r in resume.skip_succeeded(found, history).collect()}
    assert left == {("get(long)", "METHOD"), ("CLASS", "CLASS")}


def test_categories(spark):
    names = ["address", "settle", "GetX", "delta", "newest", "loader", "disableAll", "xyz", ""]
    want = ["CREATE", "UPDATE", "READ", "DELETE", "CREATE", "READ", "UPDATE", "OTHER", "OTHER"]
    assert column(spark, names, text.category) == want
    verbs = {"CREATE": "POST", "READ": "GET", "UPDATE": "PUT", "DELETE": "DELETE", "OTHER": "POST"}
    assert column(spark, names, text.verb) == [verbs[w] for w in want]
    own = PrefixLists(create=(), read=("X.",), update=("ad",))
    assert column(spark, ["add", "x.y", "xay", "getx"], lambda c: text.category(c, own)) == ["CREATE", "READ", "OTHER", "OTHER"]


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([("addX",), ("getX",), ("zip",)], "name string")
    seen = Observation()
    kept = select.keep_categories(select.add_category(df, "name"), ("READ",), seen)
    assert [r["name"] for r in kept.collect()] == ["getX"]
    assert seen.get == {"total": 3, "dropped": 2}


def test_annotation_targets(spark):
    assert select.parse_targets("@A, b.C;@@D\n\tE  a.b.C,") == ["A", "b.C", "D", "E", "a.b.C"]
    rows = [("x.A", "A"), ("x.MyA", "MyA"), ("q.b.C", "C"), ("b.C", "C"), ("qb.C", "C"), (None, "D"), ("p.q.a.b.C", None), (None, None), ("D", "Z")]
    df = spark.createDataFrame(rows, "qualified_name string, simple_name string")
    got = [r["m"] for r in df.select(select.annotation_matches("@A, b.C;@@D\n\tE  a.b.C").alias("m")).collect()]
    assert got == [True, False, True, True, False, True, True, False, True]
    assert not any(r["m"] for r in df.select(select.annotation_matches(" ,").alias("m")).collect())


def test_entries_of_top_level_classes(spark):
    t = project.tables(spark)
    found = select.select_entries(t["classes"], t["methods"], t["annotations"], "@Rpc, RpcService")
    got = {(r["class_fqn"], r["method"], r["line"], r["annotation"]) for r in found.collect()}
    want = {(project.S, "get(String)", 9), (project.S, "check(OrderDTO)", 13), ("com.lib.My_Odd", "settle()", 1), ("Bare", "address()", 1)}
    assert got == {(*w, "@Rpc, RpcService") for w in want}
    assert {r["class_fqn"] for r in index.never_indexed(found).collect()} == {"com.lib.My_Odd", "Bare"}
    per_class = select.select_entries(t["classes"], t["methods"], t["annotations"], "@RpcService", per_class=True)
    assert {r["method"] for r in per_class.collect()} == {project.sig(m) for m in project.METHODS if m[0] == project.S}
    first = select.class_entries(per_class).collect()
    assert [(r["class_fqn"], r["method"], r["line"], r["scope"]) for r in first] == [(project.S, "CLASS", 4, "CLASS")]


@pytest.mark.parametrize("name,rows", [("app", 4), ("ALL", 11), ("", 11), (None, 11), ("nowhere", 11)])
def test_modules(spark, name, rows):
    assert select.in_module(project.tables(spark)["classes"], name).count() == rows


def test_exclusions(spark):
    names = ["java.awt.Frame", "javax.swing.JFrame", "org.slf4j.Logger", "com.shop.java.awt.X", "sun.X", "sunny.X"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = select.exclude_paths(df, select.class_path(F.col("n")))
    assert [r["n"] for r in kept.collect()] == ["com.shop.java.awt.X", "sunny.X"]


def test_keys_and_paths(spark):
    assert column(spark, ["get(List<String>)", "sum(int[])", "use(Outer.Inner)"], text.method_key) == ["get_List_String", "sum_int", "use_Outer.Inner"]
    assert column(spark, ["com.a.B$C", "", "..", "a b.ü"], text.class_folder) == ["com/a/B/C", "UnknownClass", "UnknownClass", "a_b/_"]
    assert column(spark, ["com.A_b_", "com.A1", "x__12", "x_1_2"], text.drop_time_suffix) == ["com.A_b", "com.A1", "x", "x_1"]
    row = spark.createDataFrame([Row(t="c.A#get(int)#5", c="c.A", s="METHOD", m="my mod", k="CLASS")])
    path = lambda scope, options: text.relative_path("docs", F.col("t"), "doc", F.col("c"), scope, F.col("m"), options)
    got = row.select(path(F.col("s"), OutputOptions()), path(F.col("k"), OutputOptions(group_by_module=True))).first()
    assert tuple(got) == ("docs/c/A/c.A_get_int__5.doc", "docs/my_mod/c.A_get_int__5.doc")


def test_defaults():
    o = Options()
    assert (o.annotation, o.max_concurrent, o.queue_size, o.requests_per_second, o.history_limit) == ("@RpcService", 2, 32, 1.5, 200)
    assert (o.context.type_depth, o.context.called_depth, o.context.max_chars) == (2, 1, 20000)
    assert (o.retry.max_attempts, o.retry.backoff_ms) == (3, 1500)
    assert RequestOptions().deepseek_endpoint == "https://api.deepseek.com/v1/chat/completions"
    assert RequestOptions().deepseek_model == "deepseek-chat"
    assert set(fixed.STATUS_RANK) == set(fixed.STATUSES)
