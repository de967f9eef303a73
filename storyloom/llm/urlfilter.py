"""URL filters with history: a temporal join of captures against dated list entries.

A list is a table of dated entries (list, action, kind, key, at): ``add`` puts a key on a
``block`` or ``allow`` list from that moment on, ``remove`` takes it off.  Entries of one key
become validity intervals [start, stop) by the next entry's date, and every capture is decided
by the intervals that hold at its fetch time.  Kinds: ``host`` is one host, ``domain`` a host
and all below it.  The longest active key decides; at equal length allow goes before block.

The as-of join is an equi-join.  A capture's host is exploded into its suffixes (as many as it
has labels) once per distinct host and fetch time.  Intervals are exploded into the buckets of
``BUCKET_DAYS`` that they share with the span of the captures, and both sides meet on (key,
bucket) with the interval as residual condition; so a key with a long history is many rows, not
one.  Keys of at most two labels, which a large part of all captures may have, are also dealt
over ``SALTS`` parts.  The intervals are broadcast only if their bytes are at most
``BROADCAST_BYTES``; beyond that the same join shuffles.

Defined results: a null or unreadable url has no host and is kept; a null fetch time has no
active entries and is kept; entries at the very fetch time count; of several entries of one
key and moment the last by action name counts; an entry without key or date does nothing;
repeated captures and entries change nothing; without entries or captures nothing is blocked;
very long urls are read whole; an IP address has no suffixes.  Captures keep all their columns,
of whatever name; only columns called host, matched or blocked are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .cluster import staged

BUCKET_DAYS, SALTS = 30, 16
#: Bytes of exploded intervals up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

#: The dated list of the query: (list, action, kind, key, at). Fixed values.
ENTRIES = [
    ("block", "add", "domain", "spam-farm.example.org", "2024-01-01"),
    ("block", "remove", "domain", "spam-farm.example.org", "2024-05-10"),
    ("block", "add", "domain", "spam-farm.example.org", "2024-09-01"),
    ("block", "add", "domain", "cheap-pills.example.com", "2023-06-15"),
    ("allow", "add", "host", "www.cheap-pills.example.com", "2024-11-01"),
    ("block", "add", "domain", "tionsh.example.net", "2024-03-05"),
    ("block", "remove", "domain", "tionsh.example.net", "2024-03-25"),
    ("block", "add", "domain", "thther.example.org", "2024-02-01"),
    ("allow", "add", "host", "m.thther.example.org", "2024-04-01"),
    ("allow", "remove", "host", "m.thther.example.org", "2024-10-01"),
    ("block", "add", "host", "blog.tionble.example.com", "2024-07-01"),
    ("block", "add", "host", "blog.ththan.example.net", "2024-12-20"),
    ("block", "add", "domain", "example.invalid", "2024-01-01"),
]

#: Scheme (or none), authority with the part before its last @ left out, host or bracketed address.
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\s]*)"
ADDRESS = r"^\[|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def entries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e} 00:00:00 UTC')" for a, b, c, d, e in ENTRIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(list, action, kind, key, at)")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A dated list from CSV files with a header (list, action, kind, key, at); dates are UTC, rows that do not parse go."""
    raw = spark.read.csv(path, header=True, schema="list string, action string, kind string, key string, at string")
    at = F.try_to_timestamp(F.concat(F.rpad(F.trim("at"), 10, " "), F.lit(" 00:00:00 UTC")), F.lit("yyyy-MM-dd HH:mm:ss VV"))
    full = F.try_to_timestamp(F.concat(F.substring(F.translate(F.trim("at"), "T", " "), 1, 19), F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss VV"))
    low = raw.select(*(F.lower(F.trim(c)).alias(c) for c in ("list", "action", "kind", "key")), F.coalesce(full, at).alias("at"))
    return low.filter("list IN ('block', 'allow') AND action IN ('add', 'remove') AND kind IN ('host', 'domain') AND key <> '' AND at IS NOT NULL")


def intervals(listed: DataFrame) -> DataFrame:
    """(list, kind, key, start, stop): when each key was on its list; stop is null while it still is."""
    same = ["list", "kind", "key"]
    events = listed.filter("key IS NOT NULL AND at IS NOT NULL").groupBy(*same, "at").agg(F.max("action").alias("action"))
    events = events.withColumn("stop", F.lead("at").over(Window.partitionBy(*same).orderBy("at")))
    return events.filter("action = 'add'").select(*same, F.col("at").alias("start"), "stop")


def host_of(url: Column) -> Column:
    """The lowered host of an absolute or scheme-relative url, without user, port and closing dots; null if it has none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (BUCKET_DAYS * 86400)).cast("int")


def _wide(key: Column) -> Column:
    return F.size(F.split(key, r"\.")) <= 2


def _dealt(listed: DataFrame, low: int, high: int) -> DataFrame:
    """Intervals once per bucket of [low, high] and, for keys of few labels, per part."""
    valid = intervals(listed.select("list", "action", "kind", F.rtrim(F.lower("key"), F.lit(".")).alias("key"), "at"))
    first = F.greatest(_bucket(F.col("start")), F.lit(low))
    last = F.least(F.coalesce(_bucket(F.col("stop")), F.lit(high)), F.lit(high))
    valid = valid.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    parts = F.when(_wide(F.col("key")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = valid.withColumn("_bucket", F.explode(F.sequence("_first", "_last"))).withColumn("_part", F.explode(parts))
    return spread.select("key", "_bucket", "_part", "list", "kind", "start", "stop")


def decide(captures: DataFrame, listed: DataFrame, url_col: str = "url", time_col: str = "captured_at") -> DataFrame:
    """``captures`` with host, matched (the deciding key, or null) and blocked."""
    own = [c for c in captures.columns if c not in ("host", "matched", "blocked")]
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_capture"), host_of(F.col(url_col)).alias("_host"), F.col(time_col).cast("timestamp").alias("_time"))
    asked = rows.filter("_host IS NOT NULL AND _time IS NOT NULL").select("_host", "_time").distinct()
    span = asked.agg(F.min(_bucket(F.col("_time"))).alias("low"), F.max(_bucket(F.col("_time"))).alias("high")).first()
    if span["low"] is None:
        table = _dealt(listed, 0, -1)
    else:
        table = staged(_dealt(listed, span["low"], span["high"]), "urlfilter-intervals")
        weight = table.agg(F.coalesce(F.sum(F.octet_length("key") + F.lit(64)), F.lit(0)).alias("n")).first()["n"]
        table = F.broadcast(table) if weight <= BROADCAST_BYTES else table
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    suffixes = F.when(F.col("_host").rlike(ADDRESS), F.array("_host")).otherwise(suffixes)
    keyed = asked.select("_host", "_time", _bucket(F.col("_time")).alias("_bucket"), F.explode(suffixes).alias("key"))
    keyed = keyed.withColumn("_part", F.when(_wide(F.col("key")), F.pmod(F.xxhash64("_host", "_time"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    found = keyed.join(table, ["key", "_bucket", "_part"])
    found = found.filter("start <= _time AND (stop IS NULL OR stop > _time) AND (kind = 'domain' OR key = _host)")
    first = F.max_by(F.struct("key", "list"), F.struct(F.length("key"), (F.col("list") == "allow").cast("int")))
    ruled = found.groupBy(F.col("_host").alias("_h"), F.col("_time").alias("_t")).agg(first.alias("_rule"))
    out = rows.join(ruled, (F.col("_host") == F.col("_h")) & (F.col("_time") == F.col("_t")), "left")
    return out.select(*(F.col("_capture")[c].alias(c) for c in own), F.col("_host").alias("host"), F.col("_rule.key").alias("matched"), F.coalesce(F.col("_rule.list") == "block", F.lit(False)).alias("blocked"))


def captured(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch time: the query takes day page_id mod 366 of 2024, UTC."""
    day = F.pmod(F.col("page_id"), F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + day * 86400).alias("captured_at"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("string").alias("captured_on"))


def filtered(pages: DataFrame) -> DataFrame:
    return decide(captured(pages), entries(pages.sparkSession)).select("page_id", "url", "captured_on", "host", "matched", "blocked")


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)

SQL = f"""
WITH listed(list, action, kind, key, dated) AS (VALUES {_VALUES}),
events AS (SELECT list, kind, key, dated, max(action) AS action FROM listed GROUP BY ALL),
valid AS (
  SELECT list, kind, key, dated AS start, action, lead(dated) OVER (PARTITION BY list, kind, key ORDER BY dated) AS stop FROM events
),
captures AS (
  SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS t,
         nullif(rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.'), '') AS host
  FROM pages
),
ranked AS (
  SELECT c.r, v.key, v.list, row_number() OVER (PARTITION BY c.r ORDER BY length(v.key) DESC, v.list) AS n
  FROM captures c JOIN valid v
    ON v.action = 'add' AND v.start <= c.t AND (v.stop IS NULL OR v.stop > c.t)
   AND (c.host = v.key OR v.kind = 'domain' AND ends_with(c.host, '.' || v.key) AND NOT regexp_matches(c.host, '{ADDRESS}'))
)
SELECT c.page_id, c.url, strftime(c.t, '%Y-%m-%d') AS captured_on, c.host, k.key AS matched, coalesce(k.list = 'block', false) AS blocked
FROM captures c LEFT JOIN ranked k ON c.r = k.r AND k.n = 1
"""
