"""Column functions on names, keys, paths and texts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribeloom.functions import fixed
from scribeloom.options import OutputOptions, PrefixLists

# Fixed value: blanks at the ends of a text: controls that count as blanks, and
# the Unicode space, line and paragraph separators.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trim_all(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_all(text) == "")


def plain_breaks(text: Column) -> Column:
    """CRLF and CR breaks turned into LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(content: Column) -> Column:
    """Lines of a text; a break at the end is followed by one empty line.

    Splitting at one plain character is much faster than at a pattern.
    """
    return F.split(plain_breaks(content), "\n", -1)


def rows_of(array: Column) -> Column:
    """One row per element of an array that is never empty.

    For a plain explode Spark infers a filter on the array and computes the
    array twice; the outer form has no such filter.
    """
    return F.explode_outer(array)


def base_name(signature: Column) -> Column:
    """Method name of a signature: the text before the first parenthesis."""
    return F.substring_index(signature, "(", 1)


def _by_prefix(name: Column, prefixes: PrefixLists, values: dict[str, str]) -> Column:
    out = None
    for label, words in prefixes.by_category():
        hit = F.lower(name).rlike(r"\A(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")
        out = F.when(hit, values[label]) if out is None else out.when(hit, values[label])
    return out.otherwise(values[fixed.OTHER])


def category(name: Column, prefixes: PrefixLists = PrefixLists()) -> Column:
    """Category of a method name by its first matching prefix."""
    return _by_prefix(name, prefixes, {c: c for c in (*fixed.CATEGORIES, fixed.OTHER)})


def verb(name: Column, prefixes: PrefixLists = PrefixLists()) -> Column:
    """HTTP verb of a method name's category."""
    return _by_prefix(name, prefixes, fixed.VERBS)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_")


def method_key(signature: Column) -> Column:
    """Safe form of a signature as it is found in file names."""
    return F.rtrim(safe_name(signature), F.lit("_"))


def task_id(class_fqn: Column, method: Column, created_at: Column) -> Column:
    return F.concat_ws("#", class_fqn, method, created_at.cast("string"))


def entry_id(class_fqn: Column, method: Column, file: Column, module: Column) -> Column:
    """What an entry is, whatever its tasks are called: a class that is declared
    in two modules has two entries for a method."""
    named = (class_fqn.alias("class_fqn"), method.alias("method"), file.alias("file"), module.alias("module"))
    return F.sha2(F.to_json(F.struct(*named)), 256)


def class_folder(class_fqn: Column) -> Column:
    """Folder of a class: one level per package and class name."""
    parts = F.filter(F.split(class_fqn, r"[.$]", -1), lambda p: ~is_blank(p))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "[^a-zA-Z0-9_-]", "_"))
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("UnknownClass"))


def relative_path(
    root: str, task: Column, extension: str, class_fqn: Column, scope: Column, module: Column,
    options: OutputOptions = OutputOptions(),
) -> Column:
    """Path of a document: root, module folder, class folders, file."""
    module_folder = F.when(~is_blank(module), safe_name(module)) if options.group_by_module else F.lit(None)
    folder = F.when(scope == "METHOD", class_folder(class_fqn))
    file_name = F.concat(safe_name(task), F.lit("." + extension))
    return F.concat_ws("/", F.lit(root), module_folder.cast("string"), folder, file_name)


def bundle_path(task: Column) -> Column:
    return F.concat(F.lit("context-bundles/"), safe_name(task), F.lit(".txt"))


def json_path(task: Column) -> Column:
    return F.concat(F.lit("method-docs/"), safe_name(task), F.lit(".json"))


def drop_time_suffix(stem: Column) -> Column:
    """Take off digits at the end together with the underscores before them."""
    return F.regexp_replace(stem, r"_+\p{Nd}*\z", "")


def strip_think(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"(?is)<\s*think\s*>.*?<\s*/\s*think\s*>", ""))


# A text whose first line opens a fence and whose last line closes it.
_IN_LINE = r"[\p{Z}\t\x0B\f\x1C-\x1F]*"
_EDGE = r"[\x{FEFF} \n\r\t]*"
_NEW_LINE = r"(?:\r\n|\n|\r)"
FENCED = (
    rf"(?s)\A{_EDGE}{_IN_LINE}```(?i:markdown|md|html|json|text)?{_IN_LINE}{_NEW_LINE}"
    rf"(?:(.*?){_NEW_LINE})?{_IN_LINE}```{_IN_LINE}{_EDGE}\z"
)


def unwrap_fence(text: Column) -> Column:
    """Take off one code fence around the whole text; other texts stay as they are."""
    body = plain_breaks(F.regexp_extract(text, FENCED, 1))
    return F.when(text.rlike(FENCED), trim_end(body)).otherwise(text)


def clean_entities(text: Column) -> Column:
    """Undo a few escapes, in this order."""
    # The escapes and what they stand for.
    for escape, plain in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("\\u003c", "<"), ("\\u003e", ">")):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text


def numbered_each(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end with their numbers, an element each; numbers past the
    end get empty lines."""
    return F.transform(
        F.sequence(start, end),
        lambda n: F.format_string(fixed.NUMBERED_LINE, n, F.coalesce(F.get(lines, n - 1), F.lit(""))),
    )


def numbered(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end with their numbers, as one text."""
    return F.when(start <= end, F.array_join(numbered_each(lines, start, end), "")).otherwise("")


def joined(numbered_lines: Column, first: Column, start: Column, end: Column) -> Column:
    """Lines start to end of numbered lines that begin with the line `first`."""
    part = F.slice(numbered_lines, start - first + 1, F.greatest(end - start + 1, F.lit(0)))
    return F.when(start <= end, F.array_join(part, "")).otherwise("")
