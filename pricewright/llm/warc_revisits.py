"""WARC server-not-modified revisits, resolved to the responses they stand for.

A revisit record (a 304 answer) holds no payload. It is joined as of its date
to the latest earlier full response with the same canonical URL. The validators
of both must agree; then the payload is that of the response and its headers
are the stored ones, updated by those that a 304 may change.

Only a whole answer is a full response: another status than 200 (an error, a
part, a stored 304) answers no revisit.

The as-of join takes two levels, so that a URL of very many captures isn't one
group: within a URL and hour, and then over one row for each hour of the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import load

# Query parameters that only track visits, headers that describe the stored payload, and those that
# are of one connection or proxy only and aren't stored.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
FULL = 200
PAYLOAD_HEADERS = ["content-encoding", "content-length", "content-range", "content-type"]
HOP_HEADERS = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Scheme-less form: host in lower case without www. or default port, no fragment, no tracking parameters.

    Null stays null; a text that is no URL is only trimmed.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    query = F.regexp_replace(rest, r"^[^?]*\??", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i)({TRACKING})(=|$)"))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def is_full() -> Column:
    return F.coalesce((F.col("warc_type") == "response") & (F.col("status") == FULL), F.lit(False))


def one_record(records: DataFrame) -> DataFrame:
    """One row for each record_id: of several the latest, then the greatest by type, URL, status and headers.

    Rows without a record_id are left out.
    """
    named = records.where("record_id is not null").select("record_id", "url", "warc_date", "warc_type", "status", "headers")
    order = F.struct("warc_date", "warc_type", "url", "status", F.to_json(F.array_sort(F.map_entries("headers"))))
    held = F.struct("url", "warc_date", "warc_type", "status", "headers")
    return named.groupBy("record_id").agg(F.max_by(held, order).alias("r")).select("record_id", "r.*")


def latest_response(records: DataFrame) -> DataFrame:
    """(record_id, ref_id) of each revisit: the latest full response of its URL that is earlier.

    Earlier is by (warc_date, record_id), so of records with one date the
    smaller id comes first. Records without URL or date refer to nothing.
    """
    keyed = records.where("record_id is not null").select(
        "record_id",
        "warc_date",
        "warc_type",
        F.coalesce(canonical_url(F.col("url")), F.concat(F.lit(" "), F.col("record_id").cast("string"))).alias("site"),
        F.coalesce(F.date_trunc("hour", "warc_date"), F.lit("0001-01-01").cast("timestamp")).alias("hour"),
        F.when(
            is_full() & F.col("url").isNotNull() & F.col("warc_date").isNotNull(),
            F.struct("warc_date", "record_id"),
        ).alias("full"),
    )
    in_hour = Window.partitionBy("site", "hour").orderBy("warc_date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = keyed.withColumn("same_hour", F.last("full", ignorenulls=True).over(in_hour))
    revisits = marked.where("warc_type = 'revisit'").select("record_id", "warc_date", "site", "hour", "same_hour")
    by_hour = keyed.where("full is not null").groupBy("site", "hour").agg(F.max("full").alias("newest"))
    hours = by_hour.unionByName(revisits.select("site", "hour", F.lit(None).cast(by_hour.schema["newest"].dataType).alias("newest")).distinct())
    hours = hours.groupBy("site", "hour").agg(F.max("newest").alias("newest"))
    before = Window.partitionBy("site").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.withColumn("carried", F.last("newest", ignorenulls=True).over(before)).select("site", "hour", "carried")
    found = revisits.join(carried, ["site", "hour"], "left")
    usable = F.when(F.col("warc_date").isNotNull(), F.coalesce("same_hour", "carried"))
    return found.select("record_id", usable["record_id"].alias("ref_id"))


def _validator(headers: str, name: str) -> Column:
    value = F.trim(F.col(headers)[name])
    return F.nullif(F.regexp_replace(value, "^W/", "") if name == "etag" else value, F.lit(""))


def merge_headers(stored: str, fresh: str) -> Column:
    """Stored headers updated by those that a 304 answer may change.

    Left out are what describes the payload, what is of one connection or proxy
    only, the fields that the answer's Connection header names, and null values.
    """
    old = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    new = F.coalesce(fresh, F.create_map().cast("map<string,string>"))
    named = F.transform(F.split(F.lower(F.coalesce(new["connection"], F.lit(""))), ","), lambda name: F.trim(name))
    new = F.map_filter(new, lambda k, v: ~k.isin(PAYLOAD_HEADERS + HOP_HEADERS) & ~F.array_contains(named, k) & v.isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, ref_id, status and headers.

    ``records``: record_id, url, warc_date, warc_type (response or revisit),
    status (of the answer; null is no full response) and headers, a map with
    lower-case names; other columns and types of record are ignored. status is resolved, changed (validators differ), unverified (no
    validator on both sides to compare) or missing (no earlier response);
    headers are merged where resolved, else null. Entity tags decide before
    Last-Modified, compared weakly. A record_id that repeats is one record, by
    ``one_record``.
    """
    unique = one_record(records)
    refs = latest_response(unique)
    fresh = unique.where("warc_type = 'revisit'").select("record_id", F.col("headers").alias("fresh"))
    stored = unique.where(is_full()).select(F.col("record_id").alias("ref_id"), F.col("headers").alias("stored"))
    both = fresh.join(refs, "record_id").join(stored, "ref_id", "left")
    tags = _validator("fresh", "etag"), _validator("stored", "etag")
    dates = _validator("fresh", "last-modified"), _validator("stored", "last-modified")
    same = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    status = (
        F.when(F.col("ref_id").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    )
    return both.withColumn("status", status).select(
        "record_id", "ref_id", "status", F.when(F.col("status") == "resolved", merge_headers("stored", "fresh")).alias("headers")
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """``pages`` as WARC records: every page as a full response, followed by revisits of it.

    Page n is captured n minutes into the crawl, as record 4n. Records 4n+1 and
    4n+2 are revisits, one hour and three days later; the first has the page's
    entity tag, the second only its modification date, and that of every
    seventh page comes with another tag. Record 4n+3 of every fifth page is a
    not-found answer, half an hour after the capture.
    """
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    # the first revisit also has fields of its connection, which no merge may keep
    tag, changed = F.md5("html"), (F.col("page_id") % 7 == 0)
    modified = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    answer = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"),
        F.lit("date"), F.lit("0"), F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("server"), F.lit("origin"),
    )
    first = F.create_map(
        F.lit("content-length"), F.lit("0"), F.lit("date"), F.lit("1"), F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("cache-control"), F.lit("max-age=60"),
        F.lit("connection"), F.lit("Keep-Alive, X-Trace"), F.lit("keep-alive"), F.lit("timeout=5"), F.lit("x-trace"), F.lit("7"), F.lit("proxy-authenticate"), F.lit("Basic"), F.lit("x-cache"), F.lit("hit"),
    )
    second = F.map_concat(
        F.create_map(F.lit("date"), F.lit("2"), F.lit("last-modified"), modified),
        F.when(changed, F.create_map(F.lit("etag"), F.lit("other"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    rows = F.array(
        *(
            F.struct(F.lit(n).alias("n"), F.lit(later).alias("later"), F.lit(kind).alias("warc_type"), F.lit(status).alias("status"), headers.alias("headers"))
            for n, later, kind, status, headers in ((0, 0, "response", 200, answer), (1, 3600, "revisit", 304, first), (2, 259_200, "revisit", 304, second), (3, 1800, "response", 404, first))
        )
    )
    each = pages.select("page_id", "url", start.alias("start"), F.explode(rows).alias("r")).where("r.n < 3 or page_id % 5 = 0")
    return each.select(
        (F.col("page_id") * 4 + F.col("r.n")).alias("record_id"),
        "url",
        (F.col("start") + F.make_dt_interval(secs=F.col("r.later").cast("decimal(18,6)"))).alias("warc_date"),
        F.col("r.warc_type").alias("warc_type"),
        F.col("r.status").alias("status"),
        F.col("r.headers").alias("headers"),
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    resolved = resolve_revisits(capture_log(pages))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    page = F.floor(F.col("record_id") / 4)
    payload = pages.select(F.col("page_id").alias("ref_page"), F.sha2("html", 256).alias("payload_sha256"))
    rows = resolved.select(
        "record_id", page.alias("page_id"), "ref_id", "status", listed.alias("headers"),
        F.when(F.col("status") == "resolved", F.floor(F.col("ref_id") / 4)).alias("ref_page"),
    )
    return rows.join(payload, "ref_page", "left").select("record_id", "page_id", "ref_id", "status", "headers", "payload_sha256")


OP8_SQL = rf"""
WITH c AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://', '') AS bare FROM pages
), u AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.|:(80|443)$', '') AS host, regexp_extract(bare, '^[^/?]*(.*)$', 1) AS rest FROM c
), s AS (
  SELECT page_id, html, host || CASE WHEN regexp_extract(rest, '^[^?]*') = '' THEN '/' ELSE regexp_extract(rest, '^[^?]*') END ||
         CASE WHEN q = '' THEN '' ELSE '?' || q END AS site
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({TRACKING})(=|$)'))), '&') AS q FROM u)
), r AS (
  SELECT page_id * 4 + n AS record_id, page_id, n, site, page_id * 60 + CASE n WHEN 0 THEN 0 WHEN 1 THEN 3600 ELSE 259200 END AS at, html,
         md5(html) AS tag, 'day ' || (page_id % 1000) AS modified
  FROM s, (SELECT unnest([0, 1, 2]) AS n)
), j AS (
  SELECT v.record_id, v.page_id, v.n, v.tag, v.modified, max_by(f.record_id, f.at * 1000000 + f.record_id) AS ref_id
  FROM r v LEFT JOIN r f ON f.site = v.site AND f.n = 0 AND (f.at < v.at OR (f.at = v.at AND f.record_id < v.record_id))
  WHERE v.n > 0 GROUP BY ALL
), k AS (
  SELECT j.*, f.html, f.tag AS ftag, f.modified AS fmodified,
         CASE WHEN ref_id IS NULL THEN 'missing'
              WHEN CASE WHEN j.n = 1 THEN j.tag = f.tag WHEN j.page_id % 7 = 0 THEN false ELSE j.modified = f.modified END THEN 'resolved'
              ELSE 'changed' END AS status
  FROM j LEFT JOIN r f ON f.record_id = ref_id
)
SELECT record_id, page_id, ref_id, status,
       CASE WHEN status = 'resolved' THEN CASE WHEN n = 1
         THEN 'cache-control=max-age=60' || chr(10) || 'content-length=' || octet_length(encode(html)) || chr(10) || 'content-type=text/html' || chr(10) || 'date=1' || chr(10) || 'etag=W/' || tag || chr(10) || 'last-modified=' || fmodified || chr(10) || 'server=origin' || chr(10) || 'x-cache=hit'
         ELSE 'content-length=' || octet_length(encode(html)) || chr(10) || 'content-type=text/html' || chr(10) || 'date=2' || chr(10) || 'etag=' || ftag || chr(10) || 'last-modified=' || modified || chr(10) || 'server=origin'
       END END AS headers,
       CASE WHEN status = 'resolved' THEN sha256(html) END AS payload_sha256
FROM k
"""
