"""URL filters by dated lists: entries become validity intervals, and captures are joined as of their fetch time.

An entry names a host, a domain (it covers the hosts below it) or a host with its first path segment. A list's
history is a table of dated actions, ``add`` or ``remove``; an entry is active from an add until the next
remove of the same entry in the same list (later adds in between change nothing). Of actions on the same
entry at the same time, remove counts.

Captures are reduced to distinct (host, first segment, time) before anything is matched; each of those looks
up its own few keys. The join is on key and period (32 days), so one host that holds a third of all
captures is spread over its periods, and an entry with a long history meets each capture with one period of it only.
Functions of Spark SQL only.

Null URL, or a URL without a host: never blocked. Null time: never blocked. Rows of the history with a null list, key, action or time are left
out. Repeated captures give equal rows each. Of entries that are equally specific the first by key, start and list is reported. An empty history blocks nothing. Extra columns of captures are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 32
MAX_BROADCAST_KEYS = 1_000_000
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _HOST, 1)


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _SEGMENT, 1)


def intervals(history: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (null: still active) from history's list, key, action, at."""
    rows = history.select("list", "key", "action", "at").where(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    state = rows.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # remove sorts after add
    w = Window.partitionBy("list", "key").orderBy("at")
    changes = state.withColumn("before", F.lag("action").over(w)).where(~F.col("action").eqNullSafe(F.col("before")))
    return changes.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def _period(at: Column) -> Column:
    return F.floor(F.unix_date(at.cast("date")) / PERIOD_DAYS).cast("int")


def evaluate(captures: DataFrame, active: DataFrame, url: str = "url", at: str = "fetched_at", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep's columns, host, fetched_at, blocked, n_entries, lists, rule and listed_from (of the most specific, then first entry)."""
    rows = captures.select(*keep, host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("segment"), F.col(at).alias("fetched_at"))
    asked = rows.where(F.length("host") > 0).where(F.col("fetched_at").isNotNull()).select("host", "segment", "fetched_at").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(F.length("segment") > 0, F.array_append(domains, F.concat_ws("/", "host", "segment"))).otherwise(domains)
    asked = asked.withColumn("key", F.explode(keys)).withColumn("period", _period(F.col("fetched_at")))
    # every capture asks for its top-level domain; a key that no list has is dropped before anything is moved, where the lists' keys are few enough to be broadcast
    listed = active.select("key").distinct()
    if listed.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        asked = asked.join(F.broadcast(listed), "key", "left_semi")
    horizon = captures.agg(F.max(at)).first()[0]  # one value: periods after the last capture are not needed
    spans = active.where(F.col("valid_from") <= F.lit(horizon)).withColumn("until", F.least("valid_to", F.lit(horizon)))
    spans = spans.withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), _period(F.col("until"))))).select("list", "key", "period", "valid_from", "valid_to")
    hits = asked.join(spans, ["key", "period"]).where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    order = F.struct(-F.length("key"), F.col("key"), F.col("valid_from"), F.col("list"))
    found = hits.groupBy("host", "segment", "fetched_at").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min(order).alias("top"))
    return rows.join(found, ["host", "segment", "fetched_at"], "left").select(
        *keep, "host", "fetched_at", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.col("top.key").alias("rule"), F.col("top.valid_from").alias("listed_from"),
    )
