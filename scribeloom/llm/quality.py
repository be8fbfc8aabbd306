"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds one ratio of a text. All ratios are built-in expressions, so a
scan, one projection and nothing else is planned: no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeloom.llm.common import NOT_SPACE, SPACE, held, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

STOP_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "that", "was", "it", "for", "on", "with", "as", "this", "by", "be",
    "are", "at", "from", "or", "an", "not", "have", "had", "but", "which", "you", "he", "she", "they", "we", "i",
    "de", "la", "le", "et", "en", "les", "des", "un", "du", "une", "est", "pour", "que", "qui", "dans", "au", "par",
    "pas", "avec", "sur", "se", "ne", "ce", "il", "elle", "son", "sa",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "für", "nicht", "auf", "ist", "im", "eine", "ein",
    "dem", "als", "auch", "es", "er", "sie", "ich", "wir",
    "el", "las", "los", "y", "del", "con", "por", "una", "no", "lo", "su", "al", "o",
)


class Rule(NamedTuple):
    """A text passes if `low <= ratio <= high`; a missing bound is open."""

    ratio: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", 2.0, 16.0),    # characters a word
    Rule("symbols", None, 0.15),       # symbols a word
    Rule("capitals", None, 0.5),       # capitals a word character
    Rule("shouts", None, 0.25),        # words that end in two or more marks, a word
    Rule("stop_words", 0.02, None),    # stop words a word
    Rule("dup_lines", None, 0.5),      # lines seen before, a line with a word
    Rule("echoes", None, 0.3),         # words equal to the word before, a word
)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct `quality` of counts over the whole text.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words, n_capitals, n_shouts, n_echoes. A null text counts as empty. Windows
    within a text are compared by their 64-bit hashes. Columns of `docs` stay
    as they are, whatever their names; one of the name `quality` is replaced.
    A filter on the result stays above it: no array is computed per element.
    """
    body = F.coalesce(F.col("_d")[text], F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    step = step.withColumn("_w", words(body)).withColumn("_l", _lines(body)).withColumn("_h", _windows())
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("_p", F.when(F.col("_s").isNotNull(), _places()))
    length = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    found = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        length("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        length("\\p{Lu}+").cast("long").alias("n_capitals"),
        F.size(F.filter("_w", lambda w: w.endswith("!!") | w.endswith("??"))).cast("long").alias("n_shouts"),
        F.size(F.filter("_w", lambda w, i: F.coalesce(w == F.get("_w", i - 1), F.lit(False)))).cast("long").alias("n_echoes"),
    )
    kept = [F.col("_d")[c].alias(c) for c in docs.columns if c != "quality"]
    return step.select(*kept, held(found).alias("quality"))


def _lines(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE))


def _windows() -> Column:
    """A hash for each window of words."""
    last = F.size("_w") - (WINDOW - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))


def _places() -> Column:
    """Starts of windows found twice or more, ascending: in sorted order they
    have an equal neighbour."""
    there = lambda i: F.get("_s", i)["h"]
    same = lambda s, i: F.coalesce(s["h"] == there(i - 1), F.lit(False)) | F.coalesce(s["h"] == there(i + 1), F.lit(False))
    return F.sort_array(F.transform(F.filter("_s", same), lambda s: s["i"]))


def _covered() -> Column:
    """Words covered by windows that start at the places."""
    gap = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gap, F.lit(0), lambda a, b: a + b)


def ratios(q: Column) -> dict[str, Column]:
    per = lambda a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(F.lit(0.0))
    return {
        "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
        "capitals": per("n_capitals", "word_chars"), "shouts": per("n_shouts", "n_words"),
        "stop_words": per("n_stop_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "echoes": per("n_echoes", "n_words"),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def verdict(q: Column, rules: Sequence[Rule] = RULES) -> Column:
    """True if the base holds and every rule of the table passes."""
    found, passed = ratios(q), ~base_failed(q)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (found[rule.ratio] >= rule.low)
        if rule.high is not None:
            passed = passed & (found[rule.ratio] <= rule.high)
    return passed


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Empty and null texts have no words and go; repeated rows are judged one by
    one; an empty table stays empty.
    """
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = counts(docs.select(struct, F.col(f"`{text}`").alias("_text")), "_text")
    return judged.where(verdict(F.col("quality"), rules)).select("_row.*")


def op3(docs: DataFrame) -> DataFrame:
    """The digest of every document."""
    q = F.col("quality")
    return counts(docs.select("doc_id", "text")).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"),
        base_failed(q).alias("base_failed"), verdict(q).alias("kept"),
    )


def quality_cte(source: str) -> str:
    """The same counts and verdict in SQL: CTEs that end in `judged`."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = []
    names = {
        "word_length": "word_chars / n_words", "symbols": "n_symbols / n_words",
        "capitals": "CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END", "shouts": "n_shouts / n_words",
        "stop_words": "n_stop_words / n_words", "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "echoes": "n_echoes / n_words",
    }
    for rule in RULES:
        checks += [f"{names[rule.ratio]} >= {rule.low}"] if rule.low is not None else []
        checks += [f"{names[rule.ratio]} <= {rule.high}"] if rule.high is not None else []
    return rf"""
body AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM body),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM split)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
metrics AS (
  SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
         length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_capitals,
         len(list_filter(w, lambda x: ends_with(x, '!!') OR ends_with(x, '??'))) AS n_shouts,
         len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echoes
  FROM split s LEFT JOIN covered c USING (doc_id)),
based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM metrics),
judged AS (
  SELECT *, CASE WHEN base_failed THEN false ELSE {' AND '.join(checks)} END AS kept FROM based)"""


OP3_SQL = f"""WITH {quality_cte('documents').strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
