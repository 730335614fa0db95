"""Not-modified revisits of a web archive: an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import numbered, table

#: Headers that a not-modified answer may replace in the stored response. Fixed values of RFC 9110, section 15.4.5.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a url names.
TRACKING = r"(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$"
#: Captures of a slice; a url with more is cut into slices by rank of time, so that no url, however often captured, is one task.
SLICE_ROWS = 20_000


def unescaped(c: Column) -> Column:
    """Percent-encoded letters, digits, ``-._~`` as themselves, other escapes in capitals (RFC 3986, 6.2.2); no escape, no change."""

    def one(p: Column) -> Column:
        code, rest = F.substring(p, 1, 2), p.substr(F.lit(3), F.length(p))
        plain = F.char(F.conv(code, 16, 10).cast("int"))
        kept = F.when(plain.rlike("^[A-Za-z0-9._~-]$"), plain).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(p.rlike("(?s)^[0-9A-Fa-f]{2}"), F.concat(kept, rest)).otherwise(F.concat(F.lit("%"), p))

    parts = F.split(c, "%")
    return F.when(c.contains("%"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))).otherwise(c)


def undotted(path: Column) -> Column:
    """A path without ``.`` and ``..`` (RFC 3986, 5.2.4); above the root there is nothing to leave."""
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1))
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", up(kept)).otherwise(F.concat(kept, F.array(s)))
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?s)/\.{1,2}(/|$)"), F.array_join(steps, "/")).otherwise(path)


def canonical(url: str = "url") -> Column:
    """The name under which captures of a url meet: no scheme, user, port that is its scheme's own, fragment, tracking parameters, dot
    segments or closing slash; host in lower case, escapes as ``unescaped`` has them, parameters sorted. A url without ``://`` is taken
    whole; null stays null and meets nothing."""
    found = lambda i: F.regexp_extract(url, r"(?s)^([^/?#]*?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme, host = F.lower(found(1)), F.lower(found(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(undotted(unescaped(found(3))), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(unescaped(found(4)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.col(url).contains("://"), F.concat(host, path, query)).otherwise(F.col(url))


def _tag(c: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(c), '^W/', "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with those of ``fresh`` that a not-modified answer may replace; names in lower case."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve(captures: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per revisit of ``captures`` (record_id long, url, ts long, kind response or revisit, headers map with lower-case names).

    Returns record_id, url_key, ts, response_id, status and headers. The response is the latest one of the same canonical url strictly
    earlier; of several at that time the one with the largest record_id. ``resolved``: its entity tag equals the revisit's under weak
    comparison, or, if the revisit has none, its Last-Modified does; headers are then merged. ``mismatch``: the validator differs.
    ``unvalidated``: the revisit has none. ``orphan``: no earlier response, no url or no time. Only resolved rows have headers. Payloads
    take no part: the response_id says where the body is. Rows of any other kind are left out, repeated rows are answered alike.

    Captures are numbered by url and time, and cut into slices of ``slice_rows`` numbers. Within a slice a window finds the latest
    response; what earlier slices of the url end with is carried forward over one row for each url and slice. So a url with a third of
    all captures is spread like any other, whenever they were made.
    """
    rows = captures.select(
        "record_id", canonical().alias("url_key"), "ts", (F.col("kind") == "response").alias("full"), "headers"
    ).where(F.col("kind").isin("response", "revisit"))
    usable = rows.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    lost = rows.where((F.col("url_key").isNull() | F.col("ts").isNull()) & ~F.col("full"))
    # a response at the same time isn't earlier: it comes after the revisit
    usable, _ = numbered(usable, ["url_key", "ts", "full", "record_id"], "captures")
    usable = usable.withColumn("slice", F.floor(F.col("row_no") / slice_rows))
    found = F.when(F.col("full"), F.struct("ts", "record_id", "headers"))
    before = Window.partitionBy("url_key", "slice").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    near = usable.withColumn("near", F.last(found, ignorenulls=True).over(before)).where(~F.col("full"))
    closing = usable.groupBy("url_key", "slice").agg(F.max_by(found, F.when(F.col("full"), F.col("row_no"))).alias("close"))
    carried = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    closing = closing.withColumn("far", F.last("close", ignorenulls=True).over(carried)).drop("close")
    both = near.join(closing, ["url_key", "slice"]).withColumn("hit", F.coalesce("near", "far"))
    both = both.select("record_id", "url_key", "ts", "headers", "hit").unionByName(lost.select("record_id", "url_key", "ts", "headers", F.lit(None).cast("struct<ts:long,record_id:long,headers:map<string,string>>").alias("hit")))
    mine, theirs = F.col("headers"), F.col("hit.headers")
    tag, time = mine["etag"], mine["last-modified"]
    status = (
        F.when(F.col("hit").isNull(), "orphan")
        .when(tag.isNotNull(), F.when(F.coalesce(_tag(tag) == _tag(theirs["etag"]), F.lit(False)), "resolved").otherwise("mismatch"))
        .when(time.isNotNull(), F.when(F.coalesce(time == theirs["last-modified"], F.lit(False)), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    both = both.withColumn("status", status)
    return both.select("record_id", "url_key", "ts", F.col("hit.record_id").alias("response_id"), "status", F.when(F.col("status") == "resolved", merge_headers(theirs, mine)).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture history for every page: a full response and three revisits, with the same tag, with another, and one before it all
    that knows a modification time only. Revisits spell the url differently."""
    ts = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    text = lambda c: c.cast("string")

    def headers(*pairs: tuple[str, Column | str]) -> Column:
        return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for p in pairs for x in p])

    def record(n: int, url: Column, at: Column, kind: str, h: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + n).cast("long").alias("record_id"), url.alias("url"), at.cast("long").alias("ts"), F.lit(kind).alias("kind"), h.alias("headers"))

    plain, spelled = F.col("url"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#seen"))
    return pages.select(F.explode(F.array(
        record(0, plain, ts, "response", headers(("etag", tag), ("last-modified", text(ts - 100)), ("date", text(ts)), ("content-type", "text/html"), ("cache-control", "max-age=60"))),
        record(1, spelled, ts + 3600, "revisit", headers(("etag", F.concat(F.lit("W/"), tag)), ("date", text(ts + 3600)), ("cache-control", "max-age=600"), ("set-cookie", "id=1"))),
        record(2, spelled, ts + 7200, "revisit", headers(("etag", '"changed"'), ("date", text(ts + 7200)))),
        record(3, plain, ts - 10, "revisit", headers(("last-modified", text(ts - 100)), ("date", text(ts - 10)))),
    )).alias("r")).select("r.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of all pages' capture histories; headers as text, sorted by name."""
    told = resolve(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return told.select("record_id", "url_key", "ts", "response_id", "status", lines.alias("headers"))


#: The pages' urls have no escapes and no dot segments; those are tested by themselves.
ORACLE = r"""
WITH p AS (
  SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS tag, page_id * 60 AS t,
         regexp_extract(url, '(?s)^([^/?#]*?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS x FROM pages),
k AS (
  SELECT *, regexp_replace(lower(x.h), CASE lower(x.s) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || regexp_replace(x.p, '/+$', '')
    || CASE WHEN len(list_filter(string_split(x.q, '&'), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$'))) > 0
       THEN '?' || array_to_string(list_sort(list_filter(string_split(x.q, '&'), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$'))), '&') ELSE '' END AS url_key
  FROM p),
resp AS (SELECT page_id * 4 AS response_id, url_key, t AS rt, tag, t - 100 AS lm FROM k),
rev AS (
  SELECT page_id * 4 + 1 AS record_id, url_key, t + 3600 AS ts, tag AS etag, NULL AS lm, 1 AS n FROM k UNION ALL
  SELECT page_id * 4 + 2, url_key, t + 7200, '"changed"', NULL, 2 FROM k UNION ALL
  SELECT page_id * 4 + 3, url_key, t - 10, NULL, t - 100, 3 FROM k),
j AS (
  SELECT rev.*, resp.response_id, resp.rt, resp.tag, resp.lm AS rlm FROM rev LEFT JOIN resp ON rev.url_key = resp.url_key AND resp.rt < rev.ts
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY rt DESC NULLS LAST, response_id DESC NULLS LAST) = 1),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL THEN CASE WHEN etag = tag THEN 'resolved' ELSE 'mismatch' END
    WHEN lm = rlm THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, url_key, ts, response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: ' || CASE n WHEN 1 THEN 'max-age=600' ELSE 'max-age=60' END || '; content-type: text/html; date: ' || ts
    || '; etag: ' || CASE n WHEN 1 THEN 'W/' ELSE '' END || tag || '; last-modified: ' || rlm END AS headers
FROM s
"""
