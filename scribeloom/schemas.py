"""Schemas of the tables the operators read and write."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)


def _schema(**columns) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


S, I, L, B, D = StringType(), IntegerType(), LongType(), BooleanType(), DoubleType()

CLASSES = _schema(
    module=S, file=S, class_ord=I, class_fqn=S, simple_name=S, package=S,
    is_enum=B, start_line=I, end_line=I, top_level=B,
)
METHODS = _schema(
    class_fqn=S, method_ord=I, name=S, param_types=ArrayType(S), return_type=S,
    is_public=B, name_line=I, start_line=I, end_line=I, file=S,
)
# owner_kind is CLASS or METHOD; method_sig is null for a class tag.
ANNOTATIONS = _schema(owner_kind=S, class_fqn=S, method_sig=S, qualified_name=S, simple_name=S)
# from_kind is param, return, super, interface, field or inner; ref_ord is the
# place of the reference among those of the same owner and kind.
TYPE_REFS = _schema(from_kind=S, class_fqn=S, method_sig=S, ref_ord=I, to_class=S)
# call_ord is the place of the call in the caller's body.
CALLS = _schema(
    caller_class=S, caller_sig=S, call_ord=I, callee_class=S, callee_sig=S, callee_in_project=B,
)
SOURCE_FILES = _schema(module=S, path=S, content=S)

ENTRIES = _schema(
    class_fqn=S, method=S, file=S, line=I, annotation=S, module=S, class_ord=I, method_ord=I,
)

ANCHOR = _schema(file=S, start_line=I, end_line=I)
TASK_LOG = _schema(
    task_id=S, class_fqn=S, method=S, file=S, line=I, annotation=S, created_at=L, status=S,
    progress=D, message=S, scope=S, cg_summary=S, json_path=S, md_path=S, doc_path=S,
    ctx_path=S, error_type=S, error_message=S, attempt=I, updated_at=TimestampType(), seq=L,
)
# The nested form of a task row.
TASK = _schema(
    task_id=S,
    entry=_schema(class_fqn=S, method=S, file=S, line=I, annotation=S),
    created_at=L, status=S,
    progress=_schema(fraction=D, message=S),
    scope=S, cg_summary=S, slice_anchors=ArrayType(ANCHOR),
    result=_schema(json_path=S, md_path=S, doc_path=S, ctx_path=S),
    error=_schema(type=S, message=S),
    attempt=I,
)
TEMPLATES = _schema(name=S, template=S)
REPLIES = _schema(task_id=S, http_status=I, body=S)
OUTPUT_FILES = _schema(path=S)
RESUME_LINES = _schema(line_no=L, line=S)
