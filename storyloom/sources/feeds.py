"""Readers and writers: feed documents, source lists, labelled pairs, rosters, page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text, udfs, urls
from ..plans.staging import broadcast_if_small

# Named references that XML lacks.
NAMED = {
    "nbsp": 160, "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "bull": 8226, "hellip": 8230, "trade": 8482, "copy": 169, "reg": 174, "deg": 176, "plusmn": 177, "times": 215, "divide": 247, "laquo": 171,
    "raquo": 187, "cent": 162, "pound": 163, "euro": 8364, "frac12": 189, "frac14": 188, "frac34": 190, "eacute": 233, "egrave": 232, "ecirc": 234, "agrave": 224, "acirc": 226, "ocirc": 244, "ucirc": 251, "ccedil": 231, "iuml": 239,
}
# Meta tags that carry a publication date, by priority.
DATE_KEYS = [
    ("property", "article:published_time"), ("property", "og:article:published_time"), ("name", "article:published_time"), ("itemprop", "datePublished"), ("property", "datePublished"), ("name", "parsely-pub-date"),
    ("name", "publishdate"), ("name", "publish-date"), ("name", "sailthru.date"), ("name", "date"), ("name", "DC.date.issued"),
]
TIERS = {1: 10, 2: 50, 3: 100}
_ITEM = "title:string,link:string,description:string,`content:encoded`:string,guid:string,pubDate:string,`dc:date`:string"
_LINK = "array<struct<_href:string,_rel:string>>"
#: RSS has items in a channel (version 1 beside it), Atom has entries in the root; a dialect's fields are null in the others.
FEED = f"channel struct<title:string,link:string,item:array<struct<{_ITEM}>>>, item array<struct<{_ITEM}>>, link {_LINK}, entry array<struct<title:string,link:{_LINK},summary:string,content:string,id:string,published:string,updated:string>>"


def repaired(content: Column) -> Column:
    """Feed bytes as XML text: UTF-8, else Latin-1; numbers for named references; no control characters."""
    out = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    for name, code in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(f"&#{code};"))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def feed_date(c: Column) -> Column:
    plain = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in forms))


def entries(landed: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of landed feed documents (source_id, content binary), RSS or Atom: url, title, description, item id, date.

    A dialect's fields come under one name: an entry's link is its alternate one, its description the
    summary, else the content; its date the published one, else the updated one.
    """
    parsed = landed.select("source_id", F.from_xml(repaired(F.col("content")), FEED, {"mode": "PERMISSIVE"}).alias("f"))
    page = lambda links: F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    one = lambda title, link, description, guid, date: F.struct(title.alias("title"), link.alias("link"), description.alias("description"), guid.alias("guid"), date.alias("pubDate"))
    items = F.coalesce("f.channel.item", "f.item")
    rss = F.transform(items, lambda e: one(e["title"], e["link"], F.coalesce(e["description"], e["content:encoded"]), e["guid"], F.coalesce(e["pubDate"], e["dc:date"])))
    atom = F.transform("f.entry", lambda e: one(e["title"], page(e["link"]), F.coalesce(e["summary"], e["content"]), e["id"], F.coalesce(e["published"], e["updated"])))
    each = parsed.select("source_id", F.coalesce("f.channel.link", page(F.col("f.link"))).alias("channel"), F.posexplode(F.coalesce(rss, atom)).alias("position", "e"))
    each = each.join(broadcast_if_small(sources.select(F.col("id").alias("source_id"), "base_url")), "source_id")
    title = udfs.unescape(F.regexp_replace(F.coalesce("e.title", F.lit("")), "<[^>]+>", ""))
    description = F.coalesce("e.description", F.lit(""))
    return each.select(
        "source_id", "position", udfs.absolute_url(F.col("e.link"), F.col("channel"), F.col("base_url")).alias("original_url"),
        F.coalesce(F.when(F.trim(title) != "", F.trim(title)), text.derived_title(description)).alias("raw_title"), description.alias("raw_description"),
        F.coalesce("e.guid", "e.link").alias("source_item_id"), feed_date(F.col("e.pubDate")).alias("published_at"),
    )


def unsupported(sources: DataFrame) -> DataFrame:
    """Sources whose method has no reader are marked so."""
    return sources.withColumn("status", F.when((F.col("status") == "approved") & (F.col("ingest_method") != "rss"), "unsupported").otherwise(F.col("status")))


def source_list(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """A CSV of sources: trimmed, with name and url, new by name, the first of a name; tiers as priorities."""
    raw = spark.read.csv(path, header=True, schema="name string, url string, category string, tier string, ingest_method string, feed_url string, notes string")
    clean = raw.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns), F.monotonically_increasing_id().alias("line")).filter("name IS NOT NULL AND url IS NOT NULL")
    first = clean.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("line"))).filter("n = 1")
    if existing is not None:
        first = first.join(existing.select("name").distinct(), "name", "left_anti")
    tier = F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.expr("try_cast(tier AS int)"))
    known = lambda c, values, other: F.when(F.lower(c).isin(values), F.lower(c)).otherwise(other)
    return first.select(
        "name", F.col("url").alias("base_url"), known(F.col("category"), ["official", "press", "other"], "other").alias("category"), known(F.col("ingest_method"), ["rss", "html", "api", "reddit", "twitter"], "rss").alias("ingest_method"),
        "feed_url", F.coalesce(tier, F.lit(100)).alias("priority"), F.map_filter(F.create_map(F.lit("notes"), F.col("notes")), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL file of labelled pairs without blank lines, ``#`` lines and unlabelled rows."""
    schema = "a_title string, b_title string, should_merge boolean, entities array<string>, event_type string, story_key_a string, story_key_b string, summary_a string, summary_b string"
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.from_json("value", schema).alias("p")).select("p.*").filter("should_merge IS NOT NULL").withColumn("pair_id", F.pmod(F.xxhash64("a_title", "b_title"), F.lit(1 << 40)))


def page_date(html: Column) -> Column:
    """A page's date as written: linked data, then meta tags by priority, then a time element."""
    block = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    found = [udfs.linked_data_date(block)]
    for attribute, value in DATE_KEYS:
        tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']{value}["'][^>]*>""", 0)
        found.append(F.nullif(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1), F.lit("")))
    found.append(F.nullif(F.regexp_extract(html, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']""", 1), F.lit("")))
    return F.coalesce(*found)


def feed_links(html: Column, base: Column) -> Column:
    """Feed URLs that a page declares, else the usual paths under its base."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), 0), lambda t: F.lower(t).contains("application/rss+xml"))
    declared = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)), lambda h: h != "")
    usual = F.array(*(F.concat(F.rtrim(base, F.lit("/")), F.lit(p)) for p in ("/feed", "/rss", "/feed.xml", "/rss.xml", "/atom.xml", "/index.xml")))
    return F.when(F.size(declared) > 0, declared).otherwise(usual)


def wrapped_article(url: Column) -> Column:
    """The article number of a wrapper page, to be joined with a lookup of final urls."""
    return F.nullif(F.regexp_extract(url, r"/articles/(\d+)", 1), F.lit(""))


def roster(html: Column, begin: str, end: str) -> Column:
    """Names linked between two markers of a roster page, first mention first."""
    section = F.substring_index(F.element_at(F.split(html, begin), 2), end, 1)
    names = F.transform(F.regexp_extract_all(section, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), lambda n: text.person_name(F.trim(F.regexp_replace(n, "<[^>]+>", ""))))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def candidate_sources(submissions: DataFrame, sources: DataFrame) -> DataFrame:
    """Domains submitted but unknown, with how often and first by which submission."""
    known = sources.select(F.explode(F.array(urls.domain(F.col("base_url")), urls.domain(F.coalesce("feed_url", F.lit(""))))).alias("domain")).filter("domain <> ''").distinct()
    asked = submissions.withColumn("domain", urls.domain(F.col("url"))).filter("domain <> ''")
    return asked.join(known, "domain", "left_anti").groupBy("domain").agg(F.count("*").alias("times_submitted"), F.min("id").alias("first_submission"))
