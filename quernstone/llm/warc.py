"""Not-modified revisits of WARC captures, resolved by an as-of join.

A revisit (status 304, or a record of type revisit) has no body; it stands for the latest earlier full response of the same
canonical URL, if its validators agree. All captures of a URL at one second have the same earlier response, so the as-of join
is made over the distinct seconds: the last full response of each is found before anything is exchanged. The seconds are cut
into days inside each URL, and a day's last response is carried to the later ones. So no window has more rows than a day
has seconds, or a URL has days, whatever share of the captures one URL has. The revisits then look their response up; where very many
are of one URL and second, it is broadcast to them.

The resolved record has the full response's status, payload pointer and headers, with those that a not-modified
answer may renew taken from the revisit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPLIT, looked_up

#: Headers that a 304 answer may renew (RFC 9110, 15.4.5, and the freshening of stored responses, RFC 9111, 3.2). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that say where a visitor came from. Fixed values.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Captures of one URL are cut into slices of this many seconds.
SLICE = 86_400
#: Responses (about 1 KB each) that may be broadcast, as those of very many revisits at one second.
HOT = 10_000


def canonical(url: Column) -> Column:
    """http and https alike, host in lower case without www. and default ports, path without index files and trailing
    slashes, query parameters sorted and without tracking ones, no fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\d?\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    args = F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~F.substring_index(F.lower(a), "=", 1).isin(*TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise(F.lit("")))


def resolve(captures: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """captures: record_id, url, ts (seconds, long), type (response or revisit), status, headers (map of lower-case names),
    payload (a pointer such as a digest or place). Gives all rows of them with: canonical_url, source_id (the full response
    that a revisit stands for, or the row itself), resolution and, resolved, status, headers and payload.

    resolution: full (not a revisit); resolved; no_earlier (no full response of that URL before it, or a null URL or time);
    mismatch (the etag, or without a common etag last-modified, differs from the latest full response's). Weak etags agree with strong
    ones of the same value. Without any validator in common the revisit is taken to be of the latest full response. Of responses at one
    time the one of the largest record_id counts; one at the revisit's own time does not come before it. Full
    responses are those of status 200; other answers neither resolve nor are resolved. Repeated rows give repeated
    results, null headers count as empty. Other columns are left out."""
    rows = captures.select("record_id", "url", F.col("ts").cast("long").alias("ts"), "type", F.col("status").cast("int").alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload", canonical(F.col("url")).alias("canonical_url"))
    revisit = F.coalesce((F.col("type") == "revisit") | (F.col("status") == 304), F.lit(False))
    full = ~revisit & F.coalesce(F.col("status") == 200, F.lit(False)) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumns({"is_revisit": revisit, "is_full": full, "slice": F.floor(F.col("ts") / slice_seconds)})
    # what a revisit needs of the response
    answer = F.when(F.col("is_full"), F.struct("ts", "record_id", "status", F.array_sort(F.map_entries("headers")).alias("headers"), "payload"))
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    points = rows.where(placed & (F.col("is_full") | F.col("is_revisit"))).groupBy("canonical_url", "slice", "ts").agg(F.max(answer).alias("answer"), F.count_if("is_revisit").alias("n"))
    upto = lambda *key: W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)
    points = points.withColumn("near", F.last("answer", ignorenulls=True).over(upto("canonical_url", "slice", "ts")))
    # one row a slice, so a URL's window has no more rows than it has slices
    ends = points.groupBy("canonical_url", "slice").agg(F.max("answer").alias("end"))
    ends = ends.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(upto("canonical_url", "slice")).alias("far"))
    points = points.where("n > 0").join(ends, ["canonical_url", "slice"]).select("canonical_url", "ts", F.coalesce("near", "far").alias("old"), "n").where("old IS NOT NULL")
    asking = rows.where(placed & F.col("is_revisit"))
    hot = points.where(F.col("n") > F.greatest(F.lit(SPLIT), F.lit(asking.count() // HOT)))
    asked = looked_up(asking, points.drop("n"), ["canonical_url", "ts"], hot.drop("n"))
    others = rows.where(~(placed & F.col("is_revisit"))).withColumn("old", F.lit(None).cast(points.schema["old"].dataType))
    rows = asked.unionAll(others)
    rows = rows.withColumn("had", F.map_from_entries("old.headers"))
    get = lambda c, name: F.try_element_at(F.col(c), F.lit(name))
    tag = lambda c: F.regexp_replace(get(c, "etag"), "^W/", "")
    same_tag, same_time = tag("headers") == tag("had"), get("headers", "last-modified") == get("had", "last-modified")
    agrees = F.coalesce(same_tag, same_time, F.lit(True))
    resolution = F.when(~F.col("is_revisit"), "full").when(F.col("old").isNull(), "no_earlier").when(agrees, "resolved").otherwise("mismatch")
    rows = rows.withColumn("resolution", resolution)
    is_resolved = F.col("resolution") == "resolved"
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    stored = F.map_filter("had", lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return rows.select(
        "record_id", "url", "canonical_url", "ts", "type", "resolution",
        F.when(is_resolved, F.col("old.record_id")).when(~F.col("is_revisit"), F.col("record_id")).alias("source_id"),
        F.when(is_resolved, F.col("old.status")).otherwise(F.col("status")).alias("status"),
        F.when(is_resolved, F.map_concat(stored, renewed)).otherwise(F.col("headers")).alias("headers"),
        F.when(is_resolved, F.col("old.payload")).otherwise(F.col("payload")).alias("payload"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log of pages (page_id, url, html), three captures a page: the page as a full response, with the payload's MD5
    as its etag; a day and an hour later a revisit with that etag (weak); and a revisit two hours before the page, which only an
    earlier page of the same canonical URL can answer, with that page's own etag on every third page and none on the others."""
    t = F.coalesce(F.col("page_id"), F.lit(0)) * 60 + 1_700_000_000
    etag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    none = F.lit(None).cast("string")
    capture = lambda n, at, kind, status, tag, payload: F.struct(
        (F.col("page_id") * 3 + n).alias("record_id"), at.alias("ts"), F.lit(kind).alias("type"), F.lit(status).alias("status"),
        F.map_filter(F.create_map(F.lit("etag"), tag, F.lit("date"), at.cast("string"), F.lit("content-type"), F.lit("text/html" if kind == "response" else "message/http")), lambda k, v: v.isNotNull()).alias("headers"), payload.alias("payload"))
    three = F.array(
        capture(0, t, "response", 200, F.col("tag"), F.col("tag")),
        capture(1, t + 90_000, "revisit", 304, F.concat(F.lit("W/"), F.col("tag")), none),
        capture(2, t - 7_200, "revisit", 304, F.when(F.col("page_id") % 3 == 0, F.col("tag")), none),
    )
    return pages.select("page_id", "url", etag.alias("tag")).select("url", F.explode(three).alias("c")).select("url", "c.*")


#: The resolution of captures_of(pages) in one SQL query.
ORACLE = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS tag, coalesce(page_id, 0) * 60 + 1700000000 AS t,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\d?\.', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/index\.html?)?/*$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda a: a <> '' AND
               lower(string_split(a, '=')[1]) NOT IN ('fbclid','gclid','ref','utm_campaign','utm_content','utm_medium','utm_source','utm_term'))) AS args FROM p),
k AS (SELECT page_id, url, tag, t, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS cu FROM q),
v AS (SELECT page_id * 3 + 1 AS record_id, cu, t + 90000 AS ts, tag AS etag FROM k
      UNION ALL SELECT page_id * 3 + 2, cu, t - 7200, CASE WHEN page_id % 3 = 0 THEN tag END FROM k),
f AS (SELECT page_id * 3 AS record_id, cu, t AS ts, tag FROM k),
m AS (SELECT v.record_id, v.cu, v.ts, v.etag, f.record_id AS fid, f.tag, row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
      FROM v LEFT JOIN f ON v.cu = f.cu AND f.ts < v.ts)
SELECT record_id, cu AS canonical_url, ts,
       CASE WHEN fid IS NULL THEN 'no_earlier' WHEN coalesce(etag = tag, true) THEN 'resolved' ELSE 'mismatch' END AS resolution,
       CASE WHEN fid IS NOT NULL AND coalesce(etag = tag, true) THEN fid END AS source_id,
       CASE WHEN fid IS NOT NULL AND coalesce(etag = tag, true) THEN 200 ELSE 304 END AS status,
       CASE WHEN fid IS NOT NULL AND coalesce(etag = tag, true) THEN tag END AS payload,
       CASE WHEN fid IS NOT NULL AND coalesce(etag = tag, true) THEN 'text/html' ELSE 'message/http' END AS content_type,
       CAST(ts AS VARCHAR) AS date_header
FROM m WHERE n = 1
UNION ALL SELECT record_id, cu, ts, 'full', record_id, 200, tag, 'text/html', CAST(ts AS VARCHAR) FROM f
"""
