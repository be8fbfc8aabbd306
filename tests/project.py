"""A small hand-made project, its symbol tables, and what the jobs on it should
give, as written down in expected.json."""

import json
from pathlib import Path

from scribeloom import schemas

FILES = {
    # CRLF breaks, two overloads, a private method, tags on class and methods
    "/p/app/OrderService.java": "\r\n".join([
        "package com.shop;", "@RpcService", "public class OrderService {", "  public Order add(OrderDTO in) {",
        "    check(in);", "    return store.save(in);", "  }", "  @Rpc", "  public Order get(String id) {", "    return load(id);",
        "  }", "  public Order get(Long id) { return null; }", "  private void check(OrderDTO in) { audit(in); }",
        "  void audit(OrderDTO in) { check(in); }", "}",
    ]),
    "/p/app/OrderDTO.java": "package com.shop.dto;\nclass OrderDTO extends Base {\n  Item item;\n  Color color;\n  class Part {}\n}\n",
    "/p/app/Base.java": "class Base { Hidden h; }",
    "/p/lib/Item.java": "class Item {\n  Deep deep;\n}",
    "/p/lib/Deep.java": "@Entity class Deep {\n  OrderDTO back;\n}",
    "/p/lib/Color.java": "enum Color { A }",
    "/p/lib/Store.java": "class Store {\n  Order save(OrderDTO in) {\n    return flush(in);\n  }\n  Order flush(OrderDTO in) { return null; }\n}",
    "/p/lib/Empty.java": "",
}
CLASSES = [
    # module, file, ord, fqn, simple, package, enum, start, end, top
    ("app", "/p/app/OrderService.java", 0, "com.shop.OrderService", "OrderService", "com.shop", False, 2, 15, True),
    ("app", "/p/app/OrderDTO.java", 0, "com.shop.dto.OrderDTO", "OrderDTO", "com.shop.dto", False, 2, 6, True),
    ("app", "/p/app/OrderDTO.java", 1, "com.shop.dto.OrderDTO.Part", "Part", "com.shop.dto", False, 5, 5, False),
    ("app", "/p/app/Base.java", 0, "com.shop.Base", "Base", "com.shop", False, 1, 1, True),
    ("lib", "/p/lib/Item.java", 0, "com.lib.ItemVo", "ItemVo", "com.lib", False, 1, 3, True),
    ("lib", "/p/lib/Deep.java", 0, "com.lib.Deep", "Deep", "com.lib", False, 1, 3, True),
    ("lib", "/p/lib/Color.java", 0, "com.lib.Color", "Color", "com.lib", True, 1, 1, True),
    ("lib", "/p/lib/Store.java", 0, "com.lib.Store", "Store", "com.lib", False, 1, 6, True),
    ("lib", "/p/lib/Hidden.java", 0, "com.shop.HiddenDTO", "HiddenDTO", "com.shop", False, 1, 1, True),
    ("lib", "/p/lib/Odd.java", 0, "com.lib.My_Odd", "My_Odd", "com.lib", False, 1, 1, True),
    ("lib", "/p/lib/Bare.java", 0, "Bare", "Bare", "", False, 1, 1, True),
]
S, D = "com.shop.OrderService", "com.shop.dto.OrderDTO"
METHODS = [
    # class, ord, name, params, returns, public, name line, start, end, file
    (S, 0, "add", ["OrderDTO"], "Order", True, 4, 4, 7, "/p/app/OrderService.java"),
    (S, 1, "get", ["String"], "Order", True, 9, 8, 11, "/p/app/OrderService.java"),
    (S, 2, "get", ["Long"], "Order", True, 12, 12, 12, "/p/app/OrderService.java"),
    (S, 3, "check", ["OrderDTO"], "void", False, 13, 13, 13, "/p/app/OrderService.java"),
    (S, 4, "audit", ["OrderDTO"], "void", False, 14, 14, 14, "/p/app/OrderService.java"),
    ("com.lib.Store", 0, "save", ["OrderDTO"], "Order", False, 2, 2, 4, "/p/lib/Store.java"),
    ("com.lib.Store", 1, "flush", ["OrderDTO"], "Order", False, 5, 5, 5, "/p/lib/Store.java"),
    ("com.shop.dto.OrderDTO.Part", 0, "inner", [], "void", True, 5, 5, 5, "/p/app/OrderDTO.java"),
    ("com.lib.My_Odd", 0, "settle", [], "void", True, 1, 1, 1, "/p/lib/Odd.java"),
    ("Bare", 0, "address", [], "void", True, 1, 1, 1, "/p/lib/Bare.java"),
]
ANNOTATIONS = [
    ("CLASS", S, None, "com.rpc.RpcService", "RpcService"),
    ("METHOD", S, "add(OrderDTO)", "org.x.MyRpcService", "MyRpcService"),
    ("METHOD", S, "get(String)", "com.rpc.Rpc", "Rpc"),
    ("METHOD", S, "check(OrderDTO)", None, "Rpc"),
    ("METHOD", "com.shop.dto.OrderDTO.Part", "inner()", "com.rpc.Rpc", "Rpc"),
    ("METHOD", "com.lib.My_Odd", "settle()", "com.rpc.Rpc", "Rpc"),
    ("METHOD", "Bare", "address()", "com.rpc.Rpc", "Rpc"),
    ("CLASS", "com.lib.Deep", None, "jakarta.persistence.Entity", "Entity"),
]
TYPE_REFS = [
    ("param", S, "add(OrderDTO)", 0, D), ("return", S, "add(OrderDTO)", 0, "com.shop.Order"),
    ("param", S, "get(String)", 0, "java.lang.String"), ("return", S, "get(String)", 0, "com.lib.Deep"),
    ("param", S, "check(OrderDTO)", 0, D), ("param", S, "get(Long)", 0, "com.lib.Color"),
    ("super", D, None, 0, "com.shop.Base"), ("field", D, None, 1, "com.lib.Color"), ("field", D, None, 0, "com.lib.ItemVo"),
    ("inner", D, None, 0, "com.shop.dto.OrderDTO.Part"), ("field", "com.shop.Base", None, 0, "com.shop.HiddenDTO"),
    ("field", "com.lib.ItemVo", None, 0, "com.lib.Deep"), ("field", "com.lib.Deep", None, 0, D),
    ("super", "com.shop.dto.OrderDTO.Part", None, 0, "com.shop.HiddenDTO"),
]
CALLS = [
    (S, "add(OrderDTO)", 0, S, "check(OrderDTO)", True), (S, "add(OrderDTO)", 1, "com.lib.Store", "save(OrderDTO)", True),
    (S, "add(OrderDTO)", 2, "java.util.List", "add(Object)", False), (S, "check(OrderDTO)", 0, S, "audit(OrderDTO)", True),
    (S, "audit(OrderDTO)", 0, S, "check(OrderDTO)", True), ("com.lib.Store", "save(OrderDTO)", 0, "com.lib.Store", "flush(OrderDTO)", True),
    (S, "get(String)", 0, "com.gone.Gone", "load(String)", True),
]
TARGETS = {D, "com.shop.dto.OrderDTO.Part", "com.lib.ItemVo", "com.lib.Deep", "com.lib.Color", "com.shop.HiddenDTO"}


def tables(spark):
    rows = {
        "classes": CLASSES, "methods": METHODS, "annotations": ANNOTATIONS, "type_refs": TYPE_REFS, "calls": CALLS,
        "source_files": [(p.split("/")[2], p, c) for p, c in FILES.items()],
    }
    kinds = {
        "classes": schemas.CLASSES, "methods": schemas.METHODS, "annotations": schemas.ANNOTATIONS,
        "type_refs": schemas.TYPE_REFS, "calls": schemas.CALLS, "source_files": schemas.SOURCE_FILES,
    }
    return {name: spark.createDataFrame(rows[name], kinds[name]) for name in rows}


def sig(m):
    return f"{m[2]}({','.join(m[3])})"


# What the jobs should give for this project, written down: the types and called
# methods of each method by depth, whole context texts by entry, and which texts
# end without a mark when they are cut at a length.
EXPECTED = json.loads((Path(__file__).parent / "expected.json").read_text())
MARK = "\n... [truncated]\n"


def types_of(m, depth):
    return EXPECTED["types"][str(depth)][f"{m[0]}#{sig(m)}"]


def called_by(m, depth):
    return EXPECTED["called"][str(depth)][f"{m[0]}#{sig(m)}"]


def _cut(kind, name, context):
    text = EXPECTED[kind][f"{context.type_depth} {context.called_depth}"][name]
    if len(text) <= context.max_chars:
        return text
    return text[: context.max_chars] + ("" if [name, context.max_chars] in EXPECTED["unmarked"] else MARK)


def method_text(cls, msig, context):
    return _cut("methods", f"{cls}#{msig}", context)


def class_text(cls, context):
    return _cut("classes", cls, context)
