"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (an entry is added or removed on a date) become validity
intervals.  Every capture is joined, as of its fetch time, with the entries that
are active for its domain suffixes, its host or a prefix of its path; the most
specific active entry decides, and of equally specific ones an allowing one.

The join is an equality join on the lookup key with a time condition, so a hot
host is split by adaptive skew joins; whether the list is broadcast is left to the
size that Spark measures.  Of a path only the depths that occur in the list are
looked up.  Only ids, URLs and times move, never page bodies.

Defined results: a null or unparsable URL has no host and matches nothing; white space
before a URL, user names, ports and dots after a host name change no match; a null
time matches nothing; entries with a null field are left out; removing what is not
listed does nothing; of entries dated alike for one pattern a removal comes last;
an entry is active from its date up to, not including, the date of its removal;
repeated captures give repeated results; empty tables give empty or unmatched ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\s]*)"
PATH = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host after the last @ of the authority, without port and trailing dots."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, valid_from, valid_to) from entries
    (list, kind in domain/host/prefix, pattern, verdict in block/allow, action in add/remove, dated).

    The window is over one pattern's history in one list.
    """
    known = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "verdict", "action", "dated").dropna().distinct()
    known = known.withColumn("pattern", F.when(F.col("kind") == "prefix", F.col("pattern")).otherwise(F.rtrim(F.col("pattern"), F.lit("."))))
    w = Window.partitionBy("list", "kind", "pattern", "verdict").orderBy("dated", "action")
    steps = known.withColumn("before", F.lag("action").over(w)).where("before is null or before != action")
    spans = steps.withColumn("valid_to", F.lead("dated").over(w)).where("action = 'add'")
    return spans.where("valid_to is null or valid_to > dated").select("list", "kind", "pattern", "verdict", F.col("dated").alias("valid_from"), "valid_to")


def _keys(host: Column, path: Column, depths: Column) -> Column:
    """Lookup keys of a capture: (kind, pattern, rank); a higher rank is more specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern"), (n - i + 1).alias("rank")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(1000).alias("rank")))
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    below = F.filter(depths, lambda d: d <= F.size(parts))
    prefixes = F.transform(below, lambda d: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")).alias("pattern"), (d + 1000).alias("rank")))
    return F.when(host != "", F.concat(domains, exact, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, url, time, host, n_active long, decision (block, allow or null), blocked boolean,
    and the deciding list, kind and pattern; one row per capture."""
    spans = intervals(entries)
    depth = F.size(F.split(F.col("pattern"), "/")) - 1
    depths = spans.where("kind = 'prefix'").agg(F.array_sort(F.collect_set(depth)).alias("depths"))  # one row
    own = captures.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(time_col).alias("__at"), F.monotonically_increasing_id().alias("__row"))
    keyed = own.withColumn("host", F.coalesce(host_of(F.col("__url")), F.lit(""))).join(F.broadcast(depths))
    keys = keyed.select("__row", "__id", "__url", "__at", "host", F.explode_outer(_keys(F.col("host"), path_of(F.col("__url")), F.col("depths"))).alias("k"))
    keys = keys.select("__row", "__id", "__url", "__at", "host", "k.kind", "k.pattern", "k.rank")
    s = spans.select(F.col("list").alias("__list"), F.col("kind").alias("__kind"), F.col("pattern").alias("__pattern"), "verdict", "valid_from", "valid_to")
    hit = keys.join(s, (F.col("kind") == F.col("__kind")) & (F.col("pattern") == F.col("__pattern")) & (F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))), "left")
    # most specific, then allow over block ("a" < "b"), then the least list and pattern
    best = F.when(F.col("verdict").isNotNull(), F.struct((-F.col("rank")).alias("r"), "verdict", "__list", "__kind", "__pattern"))
    out = hit.groupBy("__row", "__id", "__url", "__at", "host").agg(F.count("verdict").alias("n_active"), F.min(best).alias("b"))
    return out.select(
        F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.col("__at").alias(time_col), "host", "n_active",
        F.col("b.verdict").alias("decision"), F.coalesce(F.col("b.verdict") == "block", F.lit(False)).alias("blocked"),
        F.col("b.__list").alias("list"), F.col("b.__kind").alias("kind"), F.col("b.__pattern").alias("pattern"),
    )


# The query's captures and list are derived from the pages by rule, since no table has dates.


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(pmod(page_id * 7919, 365) as int), cast(pmod(page_id * 31, 24) as int))").alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """For each host a history chosen by its md5, and two whole domains."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    byte = lambda i: F.conv(F.substring(F.md5("host"), 2 * i + 1, 2), 16, 10).cast("int")
    h = hosts.select("host", byte(0).alias("a"), byte(1).alias("b"), byte(2).alias("c"))
    day = lambda d: F.expr(f"timestamp'2024-01-01' + make_dt_interval({d})")

    def entry(when: str, kind: str, pattern: str, verdict: str, action: str, d: str) -> Column:
        return F.when(F.expr(when), F.struct(F.lit("hosts").alias("list"), F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day(d).alias("dated")))

    made = F.array(
        entry("a < 96", "host", "host", "block", "add", "b"),
        entry("a < 96", "host", "host", "block", "remove", "b + 20 + c % 60"),
        entry("a < 32", "host", "host", "block", "add", "b + 120"),
        entry("a between 96 and 160", "prefix", "concat(host, '/en')", "block", "add", "b"),
        entry("a >= 224", "host", "host", "allow", "add", "b"),
    )
    fixed = pages.sparkSession.sql(
        """select 'domains' as list, 'domain' as kind, pattern, 'block' as verdict, action, timestamp'2024-01-01' + make_dt_interval(d) as dated
           from values ('example.net', 'add', 100), ('example.net', 'remove', 160), ('example.org', 'add', 30) as t(pattern, action, d)"""
    )
    return h.select(F.explode(F.array_compact(made)).alias("e")).select("e.*").unionByName(fixed)


ORACLE = r"""
with cut as (
  select page_id, url, timestamp '2024-01-01' + to_days(cast((page_id * 7919) % 365 as int)) + to_hours(cast((page_id * 31) % 24 as int)) as fetched_at,
         case when contains(url, '://') then split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) else '' end as rest
  from pages),
caps as (
  select page_id, url, fetched_at, rtrim(lower(split_part(list_last(string_split(split_part(rest, '/', 1), '@')), ':', 1)), '.') as host,
         case when contains(rest, '/') then substr(rest, strpos(rest, '/')) else '' end as path
  from cut),
hosts as (select distinct host from caps where host != ''),
h as (select host, cast('0x' || substr(md5(host), 1, 2) as int) as a, cast('0x' || substr(md5(host), 3, 2) as int) as b, cast('0x' || substr(md5(host), 5, 2) as int) as c from hosts),
entries as (
  select 'hosts' as list, 'host' as kind, host as pattern, 'block' as verdict, 'add' as action, b as d from h where a < 96
  union all select 'hosts', 'host', host, 'block', 'remove', b + 20 + c % 60 from h where a < 96
  union all select 'hosts', 'host', host, 'block', 'add', b + 120 from h where a < 32
  union all select 'hosts', 'prefix', host || '/en', 'block', 'add', b from h where a between 96 and 160
  union all select 'hosts', 'host', host, 'allow', 'add', b from h where a >= 224
  union all select 'domains', 'domain', 'example.net', 'block', 'add', 100
  union all select 'domains', 'domain', 'example.net', 'block', 'remove', 160
  union all select 'domains', 'domain', 'example.org', 'block', 'add', 30),
steps as (select *, lag(action) over w as before from entries window w as (partition by list, kind, pattern, verdict order by d, action)),
turns as (select * from steps where before is null or before != action),
spans as (
  select list, kind, pattern, verdict, action, timestamp '2024-01-01' + to_days(cast(d as int)) as valid_from,
         timestamp '2024-01-01' + to_days(cast(lead(d) over (partition by list, kind, pattern, verdict order by d, action) as int)) as valid_to
  from turns),
hits as (
  select c.page_id, c.url, c.fetched_at, c.host, s.list, s.kind, s.pattern, s.verdict,
         case s.kind when 'domain' then len(string_split(s.pattern, '.')) when 'host' then 1000 else 1000 + len(string_split(s.pattern, '/')) - 1 end as rank
  from caps c join spans s on s.action = 'add' and c.fetched_at >= s.valid_from and (s.valid_to is null or c.fetched_at < s.valid_to)
   and (s.kind = 'host' and s.pattern = c.host
     or s.kind = 'domain' and (c.host = s.pattern or ends_with(c.host, '.' || s.pattern))
     or s.kind = 'prefix' and starts_with(c.host || '/' || array_to_string(list_filter(string_split(lower(c.path), '/'), lambda x: x != ''), '/') || '/', s.pattern || '/'))),
best as (select *, row_number() over (partition by page_id order by rank desc, verdict, list, kind, pattern) as rn, count(*) over (partition by page_id) as n_active from hits)
select c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at, c.host, coalesce(b.n_active, 0) as n_active, b.verdict as decision, coalesce(b.verdict = 'block', false) as blocked, b.list, b.kind, b.pattern
from caps c left join best b on b.page_id = c.page_id and b.rn = 1
"""
