"""WARC: resolution of not-modified revisit records.

A revisit record says that a resource had not changed and carries no body. It
is resolved by an as-of join: by canonical url, to the latest full response
captured before it (same instant: the smaller record id is earlier). The
response's validators must agree with the revisit's: entity tags by weak
comparison if both have one, else modification dates, else payload digests.
The headers of a resolved record are those of the response, updated by the
headers that a 304 may carry.

A url may hold a third of all records, so the join is a prefix scan in two
levels. A sort of narrow records by time numbers them, stretches of
``BUCKET_ROWS`` of that order are buckets, windows run over (url, bucket), and
what a bucket hands on, its last full response, runs over the buckets of each
url: one row for ``BUCKET_ROWS`` records. Bodies are never shuffled.

Header names are compared in lower case, and are given so.

Defined cases: records with a null url, time or id are left out; a revisit
without an earlier response is an ``orphan``; without a pair of validators to
compare it is ``unverified``; with differing ones a ``mismatch``, and only a
``resolved`` record has merged headers; null header maps count as empty, and of
names that differ in case only the last counts; repeated revisit records, also
those that share an id, are each resolved once, with their own headers; of
responses of one id and time the one of largest digest of its headers counts;
urls and headers of any length are read whole; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.session import materialize

#: Records of one bucket: what one task holds of a url that fills all of it.
BUCKET_ROWS = 65_536
#: Small tables are cut into so many buckets all the same.
BUCKETS = 512
# Header fields that a not-modified response updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not select a resource.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)=[^&]*"


def canonical(url: Column) -> Column:
    """Scheme, www, default ports, fragments, tracking parameters and a trailing slash dropped; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), TRACKING, ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _same(a: str, b: str) -> Column:
    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    return (
        F.when(F.col(f"{a}.etag").isNotNull() & F.col(f"{b}.etag").isNotNull(), tag(f"{a}.etag") == tag(f"{b}.etag"))
        .when(F.col(f"{a}.last_modified").isNotNull() & F.col(f"{b}.last_modified").isNotNull(), F.col(f"{a}.last_modified") == F.col(f"{b}.last_modified"))
        .when(F.col(f"{a}.digest").isNotNull() & F.col(f"{b}.digest").isNotNull(), F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    )


def as_of(records: DataFrame) -> DataFrame:
    """For every revisit: record_id, canonical_url, own and found (structs of record_id, validators and headers; found may be null)."""
    narrow = records.where("record_id is not null and url is not null and ts is not null").select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"),
        F.struct(F.col("record_id").cast("long").alias("record_id"), "etag", "last_modified", "digest", "headers").alias("own"),
    )
    content = F.xxhash64("own.etag", "own.last_modified", "own.digest", F.to_json("own.headers"))
    placed = materialize(narrow.orderBy("ts", "record_id", F.desc("full"), content).withColumn("_m", F.monotonically_increasing_id()))
    totals = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in totals:
        starts.append((p, total))
        total += n
    offsets = records.sparkSession.createDataFrame(starts, "_p long, _start long")  # one row a partition
    size = min(BUCKET_ROWS, max(1, -(-total // BUCKETS)))
    rows = placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p")
    rows = rows.withColumn("row", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).withColumn("bucket", F.floor(F.col("row") / size)).drop("_p", "_m", "_start")

    full = F.when(F.col("full"), F.col("own"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("row")
    rows = rows.withColumn("near", F.last(full, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    handed = rows.where("full").groupBy("canonical_url", "bucket").agg(F.max_by("own", "row").alias("last_full"))
    asked = rows.where("not full and near is null").select("canonical_url", "bucket").distinct()
    steps = asked.join(handed, ["canonical_url", "bucket"], "full")
    carried = steps.withColumn("before", F.last("last_full", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.where("not full").join(carried.where("before is not null").select("canonical_url", "bucket", "before"), ["canonical_url", "bucket"], "left")
    return found.select("record_id", "canonical_url", "own", F.coalesce("near", "before").alias("found"))


def _plain(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the last counts."""
    low = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(low, lambda e: e["key"])
    last = F.filter(low, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored header map, updated by the permitted fields of the fresh one; names in lower case."""
    allowed = F.map_filter(_plain(fresh), lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(_plain(stored), lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, target_id, status, headers (map) of every revisit in ``records``
    (record_id, url, ts, kind, etag, last_modified, digest, headers)."""
    same = _same("own", "found")
    status = F.when(F.col("found").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    judged = as_of(records).select("record_id", "canonical_url", F.col("found.record_id").alias("target_id"), status.alias("status"), "own", "found")
    merged = F.when(F.col("status") == "resolved", merged_headers(F.col("found.headers"), F.col("own.headers")))
    return judged.select("record_id", "canonical_url", "target_id", "status", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records of every page: its full response at time page_id, and a later conditional request that was answered 304."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 16), F.lit('"'))
    base = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", tag.alias("etag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))

    def record(kind: str, record_id: str, ts: str, weak: str, **headers: str) -> Column:
        pairs = [x for k, v in headers.items() for x in (F.lit(k.replace("_", "-")), F.expr(v))]
        return F.struct(
            F.expr(record_id).alias("record_id"), F.col("url").alias("url"), F.expr(ts).alias("ts"), F.lit(kind).alias("kind"), F.expr(weak).alias("etag"),
            F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(*pairs).alias("headers"),
        )

    later = "page_id + 1 + (page_id * 7919) % 1000"
    both = F.array(
        record("response", "page_id * 2", "page_id", "etag", content_type="'text/html'", content_length="cast(size as string)", etag="etag", date="cast(page_id as string)"),
        record("revisit", "page_id * 2 + 1", later, "concat('W/', etag)", content_length="'0'", etag="concat('W/', etag)", date=f"cast({later} as string)", cache_control="'max-age=60'"),
    )
    return base.select(F.explode(both).alias("r")).select("r.*")
