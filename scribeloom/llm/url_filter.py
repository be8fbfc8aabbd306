"""URL filters whose lists change over time.

Dated list entries become intervals in which a rule is in force, and an as-of
join holds every capture against the rules in force when it was fetched. The
join is an equality of rule and month with a comparison of times inside, so no
capture meets rules of other hosts or months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribeloom.scale import find_hot, materialize, skew_join

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FOLDER = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"
LONGEST_HOST = 253  # of a host name that can exist; a fixed value


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none or one too long."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when((host != "") & (F.length(host) <= LONGEST_HOST), host)


def folder_of(url: Column) -> Column:
    """Host and first part of the path; null if there is none."""
    part = F.regexp_extract(url, FOLDER, 1)
    return F.when(part != "", F.concat(host_of(url), F.lit("/"), part))


def rules_of(url: Column) -> Column:
    """Keys of the rules that may apply: the host, the domains it belongs to
    that have two labels or more, and its first folder."""
    labels = F.split(host_of(url), r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    domains = F.transform(starts, lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folder = F.array_compact(F.array(F.concat(F.lit("f:"), folder_of(url))))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(domains, folder)))


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def intervals(entries: DataFrame) -> DataFrame:
    """rule, since, until (null: still in force), from entries with rule, ts,
    added and seq.

    Of entries of one rule and time the one of greatest seq counts. An entry
    ends at the next one of its rule; the next one is looked for in its month
    and then in the first of later months, so a rule with any number of entries
    is spread over many tasks. Entries without a rule or time are left out.
    """
    state = entries.where("rule is not null and ts is not null").groupBy("rule", "ts").agg(
        F.max_by("added", "seq").alias("added")
    ).withColumn("month", _month(F.col("ts")))
    firsts = state.groupBy("rule", "month").agg(F.min("ts").alias("first"))
    firsts = firsts.withColumn("next_first", F.lead("first").over(W.partitionBy("rule").orderBy("month"))).drop("first")
    inside = F.lead("ts").over(W.partitionBy("rule", "month").orderBy("ts"))
    return state.withColumn("next", inside).join(firsts, ["rule", "month"]).where("added").select(
        "rule", F.col("ts").alias("since"), F.coalesce("next", "next_first").alias("until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """capture_id, url and fetched with blocked, n_rules, rule, since.

    A rule is in force from its entry up to, and without, the time of the next
    entry of the rule. `rule` is the longest in force, `since` its entry. A
    capture without host or fetch time meets no rule. Repeated captures are all
    kept. A rule that many captures meet is spread over many tasks.
    """
    rows = captures.select(F.col(f"`{capture_id}`").alias("_id"), F.col(f"`{url}`").alias("_url"), F.col(f"`{fetched}`").alias("_at"))
    in_force = materialize(intervals(entries), "intervals")
    last = rows.agg(F.max("_at")).first()[0]
    end = F.least(F.coalesce(F.col("until"), F.lit(last)), F.lit(last))
    by_month = in_force.where(F.col("since") <= F.lit(last)).withColumn(
        "month", F.explode(F.sequence(_month(F.col("since")), F.greatest(_month(end), _month(F.col("since")))))
    ) if last is not None else in_force.withColumn("month", F.lit(0)).limit(0)
    asked = rows.where("_at is not null").distinct().select(
        "_id", "_url", "_at", _month(F.col("_at")).alias("month"), F.explode(rules_of(F.col("_url"))).alias("rule")
    )
    met = skew_join(asked, by_month, ["rule", "month"], hot_left=find_hot(asked, ["rule", "month"])).where(
        (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    )
    best = F.max_by(F.struct("rule", "since"), F.struct(F.length("rule"), F.col("rule")))
    hits = met.groupBy("_id", "_url", "_at").agg(F.count("*").alias("n"), best.alias("best"))
    hits = hits.select(F.col("_id").alias("h_id"), F.col("_url").alias("h_url"), F.col("_at").alias("h_at"), "n", "best")
    same = rows["_id"].eqNullSafe(hits["h_id"]) & rows["_url"].eqNullSafe(hits["h_url"]) & rows["_at"].eqNullSafe(hits["h_at"])
    return rows.join(hits, same, "left").select(
        F.col("_id").alias(capture_id), F.col("_url").alias(url), F.col("_at").alias(fetched),
        F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_rules"),
        F.col("best.rule").alias("rule"), F.col("best.since").alias("since"),
    )


def captures_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Every page as a capture, fetched when the event of its number happened."""
    times = events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at"))
    return pages.select("page_id", "url").join(times, "page_id", "left")


def entries_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """List entries: an error on a page puts its host, its site or its folder on
    the list, a purchase takes them off; the user number of the event is the page."""
    changes = events.where(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("page_id"), "ts", (F.col("event_type") == "error").alias("added"), F.col("event_id").alias("seq")
    )
    host = host_of(F.col("url"))
    site = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    rule = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("d:"), host)).when(
        F.col("seq") % 3 == 1, F.concat(F.lit("d:"), F.nullif(site, F.lit("")))
    ).otherwise(F.concat(F.lit("f:"), folder_of(F.col("url"))))
    return changes.join(pages.select("page_id", "url"), "page_id").select(rule.alias("rule"), "ts", "added", "seq")


def op8(pages: DataFrame, events: DataFrame) -> DataFrame:
    return evaluate(captures_of(pages, events), entries_of(pages, events))


OP8_SQL = rf"""
WITH hosts AS (
  SELECT page_id, url, CASE WHEN length(h) BETWEEN 1 AND {LONGEST_HOST} THEN h END AS host, p AS part
  FROM (SELECT *, lower(regexp_extract(url, '{HOST}', 1)) AS h, regexp_extract(url, '{FOLDER}', 1) AS p FROM pages)),
entries AS (
  SELECT CASE e.event_id % 3 WHEN 0 THEN 'd:' || host
              WHEN 1 THEN 'd:' || nullif(regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), '')
              ELSE 'f:' || CASE WHEN part <> '' THEN host || '/' || part END END AS rule,
         e.ts, e.event_type = 'error' AS added, e.event_id AS seq
  FROM events e JOIN hosts h ON h.page_id = e.user_id WHERE e.event_type IN ('error', 'purchase')),
state AS (SELECT rule, ts, arg_max(added, seq) AS added FROM entries WHERE rule IS NOT NULL GROUP BY rule, ts),
intervals AS (
  SELECT * FROM (SELECT rule, ts AS since, lead(ts) OVER (PARTITION BY rule ORDER BY ts) AS until, added FROM state) WHERE added),
captures AS (SELECT h.*, e.ts AS fetched_at FROM hosts h LEFT JOIN events e ON e.event_id = h.page_id),
asked AS (
  SELECT DISTINCT page_id, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS rule
  FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM captures WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, 'f:' || host || '/' || part FROM captures WHERE host IS NOT NULL AND part <> ''),
met AS (
  SELECT c.page_id, a.rule, i.since FROM captures c JOIN asked a USING (page_id) JOIN intervals i
  ON i.rule = a.rule AND i.since <= c.fetched_at AND (i.until IS NULL OR c.fetched_at < i.until)),
hits AS (
  SELECT page_id, count(*) AS n, (list(rule ORDER BY length(rule) DESC, rule DESC))[1] AS rule,
         (list(since ORDER BY length(rule) DESC, rule DESC))[1] AS since FROM met GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_rules, h.rule, h.since
FROM captures c LEFT JOIN hits h USING (page_id)"""
