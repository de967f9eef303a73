"""The story model over the driver's tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

AS_OF = "2001-08-01 00:00:00"


class Model:
    """Lazy frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def clusters(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "archived").otherwise("merged")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("headline"), F.col("o_orderpriority").alias("event_type"), status.alias("status"),
            F.expr("o_orderdate - make_dt_interval(CAST(o_orderkey % 7 AS INT))").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"), (F.col("o_custkey") % 5).cast("int").alias("source_count"),
            (F.col("o_orderkey") % 9).cast("int").alias("click_count"), F.col("o_custkey").alias("entity_id"),
        )

    def raw_variants(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_suppkey", "l_partkey")
        part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("id"), F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("published_at"),
            F.col("l_returnflag").alias("tag"), F.col("l_discount").alias("score"), F.concat(F.lit("Part "), (F.col("l_partkey") % 50).cast("string"), F.lit(" ships - Wire"), (F.col("l_suppkey") % 3).cast("string")).alias("title"),
            F.concat(F.lit("https://s"), supplier, F.lit(".example.com/a/"), part).alias("url"), F.col("l_quantity").alias("quantity"),
        )

    def sources(self) -> DataFrame:
        k = F.col("s_suppkey")
        category = F.when(k % 3 == 0, "official").when(k % 3 == 1, "press").otherwise("other")
        status = F.when(k % 11 == 0, "unsupported").when(k % 7 == 0, "candidate").otherwise("approved")
        return self.table("supplier").select(
            k.alias("id"), F.col("s_name").alias("name"), category.alias("category"), status.alias("status"), (k % 5).cast("int").alias("fetch_error_count"), (k % 4).cast("int").alias("priority"),
            F.when(k % 13 != 0, F.lit(AS_OF).cast("timestamp_ntz") - F.expr("make_dt_interval(0, CAST(s_suppkey % 6 AS INT))")).alias("last_fetched_at"),
        )

    def variants(self) -> DataFrame:
        return self.raw_variants().join(F.broadcast(self.sources().select(F.col("id").alias("source_id"), "category")) if self._small("supplier") else self.sources().select(F.col("id").alias("source_id"), "category"), "source_id")

    def _small(self, name: str, rows: int = 1_000_000) -> bool:
        """Whether a dimension is small enough to broadcast; Parquet answers from its footers."""
        return self.table(name).count() <= rows

    def entities(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"))

    def relations(self) -> DataFrame:
        """Near misses: each cluster of a customer with the next four by id, so most are an end of eight."""
        own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        others = F.array(*(F.lead("o_orderkey", k).over(own) for k in range(1, 5)))
        pairs = self.table("orders").select(F.col("o_orderkey").alias("a"), others.alias("others")).select("a", F.explode("others").alias("b")).filter("b IS NOT NULL")
        return pairs.withColumn("score", F.when(F.col("a") % 10 != 0, (F.col("a") * 7 + F.col("b") * 13) % 97 / F.lit(97.0).cast("double")))

    def titles(self) -> DataFrame:
        """Raw items: a title of the first line's first 140 characters."""
        first = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 140)
        return self.table("documents").select(F.col("doc_id").alias("id"), F.col("source"), "lang", first.alias("title"), "text")

    def items(self) -> DataFrame:
        """Raw items of a feed: arrival by id; item ids, urls and titles repeat."""
        t = self.titles()
        source = F.regexp_extract("source", r"(\d+)", 1).cast("long")
        return t.select(
            "id", source.alias("source_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("source_item_id"),
            F.concat(F.lit("https://n"), (F.col("id") % 5).cast("string"), F.lit(".example.com/"), (F.pmod(F.crc32(F.col("title").cast("binary")), F.lit(5000))).cast("string")).alias("canonical_url"), F.col("title").alias("raw_title"),
        )

    def logs(self) -> DataFrame:
        method = F.when(F.col("event_type").isin("click", "view"), "llm").when(F.col("event_type") == "purchase", "keyword").otherwise("skip")
        result = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 3 == 0, "rejected").otherwise("approved")
        reply = F.when(F.col("event_id") % 4 == 0, F.lit('{"relevant": true, "reason": "x"}')).when(F.col("event_id") % 4 == 1, F.lit('{"relevant": false')).when(F.col("event_id") % 4 == 2, F.lit("YES, it is"))
        return self.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", method.alias("method"), result.alias("result"), F.col("value").alias("latency"), reply.alias("llm_response"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0).alias("keyword_matched"))


CLUSTERS = """clusters AS (SELECT o_orderkey AS id, 'order ' || o_orderkey AS headline, o_orderpriority AS event_type,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'archived' ELSE 'merged' END AS status, o_orderdate - to_days(CAST(o_orderkey % 7 AS INTEGER)) AS first_seen_at,
  o_orderdate AS last_seen_at, CAST(o_custkey % 5 AS INTEGER) AS source_count, CAST(o_orderkey % 9 AS INTEGER) AS click_count, o_custkey AS entity_id FROM orders)"""
SOURCES = f"""sources AS (SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'press' ELSE 'other' END AS category,
  CASE WHEN s_suppkey % 11 = 0 THEN 'unsupported' WHEN s_suppkey % 7 = 0 THEN 'candidate' ELSE 'approved' END AS status, CAST(s_suppkey % 5 AS INTEGER) AS fetch_error_count, CAST(s_suppkey % 4 AS INTEGER) AS priority,
  CASE WHEN s_suppkey % 13 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(s_suppkey % 6 AS INTEGER)) END AS last_fetched_at FROM supplier)"""
VARIANTS = f"""{SOURCES}, variants AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey, l_partkey) AS id, l_orderkey AS cluster_id, l_suppkey AS source_id, l_shipdate AS published_at,
  l_returnflag AS tag, l_discount AS score, 'Part ' || (l_partkey % 50) || ' ships - Wire' || (l_suppkey % 3) AS title, 'https://s' || l_suppkey || '.example.com/a/' || l_partkey AS url, l_quantity AS quantity, category,
  CASE category WHEN 'official' THEN 3 WHEN 'press' THEN 2 ELSE 1 END AS rank FROM lineitem JOIN sources ON l_suppkey = sources.id)"""
ENTITIES = "entities AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS entity_type FROM customer)"
RELATIONS = """placed AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
relations AS (SELECT x.k AS a, y.k AS b, CASE WHEN x.k % 10 <> 0 THEN (x.k * 7 + y.k * 13) % 97 / 97.0::DOUBLE END AS score FROM placed x JOIN placed y ON x.c = y.c AND y.n BETWEEN x.n + 1 AND x.n + 4)"""
TITLES = "titles AS (SELECT doc_id AS id, source, lang, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 140) AS title, text FROM documents)"
LOGS = """logs AS (SELECT event_id AS id, ts AS created_at, user_id, CASE WHEN event_type IN ('click', 'view') THEN 'llm' WHEN event_type = 'purchase' THEN 'keyword' ELSE 'skip' END AS method,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS result, value AS latency,
  CASE event_id % 4 WHEN 0 THEN '{"relevant": true, "reason": "x"}' WHEN 1 THEN '{"relevant": false' WHEN 2 THEN 'YES, it is' END AS llm_response, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 END AS keyword_matched,
  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS approved FROM events)"""
