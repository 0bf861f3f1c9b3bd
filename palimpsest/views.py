"""Canonical views of the driver tables, written once for Spark SQL and DuckDB.

``memories``, ``edges``, ``activations``, ``feedback``, ``tasks``, ``agents`` and
``findings`` have the columns that the operators expect.  Each is one SELECT in
which a few names differ between the dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"

_DIALECT = {
    "spark": {"ARR": "array", "DAYS": "make_dt_interval", "STR": "string", "SECONDS": "make_dt_interval(0, 0, 0, %s)", "TS": "timestamp"},
    "duckdb": {"ARR": "list_value", "DAYS": "to_days", "STR": "varchar", "SECONDS": "to_seconds(%s)", "TS": "timestamp"},
}

VIEWS = {
    "memories": f"""
      select d.doc_id as id, d.lang as agent, substr(d.text, 1, 60) as concept, d.text as content,
        ARR('src=' || d.source, 'lang=' || d.lang, 'topic=t' || cast(d.doc_id % 7 as STR), 'weight=' || cast(d.doc_id % 13 as STR), 'kind=k' || cast(d.doc_id % 3 as STR)) as tags,
        cast(case when l.quality = 1 then 0.7 when l.quality = 0 then 0.15 else 0.45 end as double) as salience,
        cast(case when l.toxic = 1 then 0.3 when l.quality = 1 then 0.8 when l.quality = 0 then 0.4 else 0.5 end as double) as confidence,
        cast(d.doc_id % 21 as bigint) as access_count,
        TS '{AS_OF}' - DAYS(cast(d.n_chars % 120 as int)) - SECONDS(cast(d.doc_id % 86400 as int)) as created_at,
        TS '{AS_OF}' - DAYS(cast(d.doc_id * 7 % 180 as int)) - SECONDS(cast(d.doc_id % 3600 as int)) as last_accessed,
        case when d.doc_id % 10 < 6 then 'active' when d.doc_id % 10 = 6 then 'staging' when d.doc_id % 10 = 7 then 'consolidated' when d.doc_id % 10 = 8 then 'fading' else 'archived' end as stage,
        d.doc_id % 17 = 0 as retracted,
        case d.doc_id % 11 when 0 then 'canonical' when 1 then 'ephemeral' when 2 then 'structural' else 'working' end as memory_class,
        case d.doc_id % 4 when 0 then 'episodic' when 1 then 'semantic' when 2 then 'procedural' else 'unclassified' end as memory_type,
        case when d.doc_id % 5 = 0 then null else d.doc_id * 3 % 1000 end as sequence,
        case when d.doc_id % 23 = 0 then d.doc_id + 1 end as superseded_by,
        case when d.doc_id % 10 = 6 then case when d.doc_id % 4 = 0 then cast(0 as bigint) else cast(86400000 as bigint) end end as ttl_ms,
        case d.doc_id % 9 when 0 then 'open' when 1 then 'in_progress' when 2 then 'blocked' when 3 then 'done' end as task_status,
        case when d.doc_id % 9 < 4 then case d.doc_id % 4 when 0 then 'urgent' when 1 then 'high' when 2 then 'medium' else 'low' end end as task_priority,
        case when d.doc_id % 9 = 2 then d.doc_id - d.doc_id % 5 end as blocked_by,
        case when d.doc_id % 6 = 0 then ARR('resolves:' || cast(d.doc_id - d.doc_id % 30 as STR), 'mentions:' || cast(d.doc_id + 1 as STR)) when d.doc_id % 6 = 1 then ARR('reopens:' || cast(d.doc_id - d.doc_id % 30 as STR)) end as refs
      from documents d left join labels l on d.doc_id = l.doc_id""",
    "edges": """
      select a.l_partkey as src, b.l_partkey as dst,
        case (a.l_partkey + b.l_partkey) % 6 when 0 then 'hebbian' when 1 then 'connection' when 2 then 'causal' when 3 then 'temporal' when 4 then 'invalidation' else 'bridge' end as type,
        least(0.1 * power(1.25, count(*)) * (1 + (a.l_partkey * 7 + b.l_partkey) % 40), 5.0) as weight, cast(0.8 as double) as confidence,
        count(*) as activation_count, max(a.l_shipdate) as last_activated
      from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey
      group by a.l_partkey, b.l_partkey""",
    "activations": """
      select event_id, user_id as agent, ts, value as latency_ms, event_id % 97 as memory_id from events where event_type in ('view', 'click')""",
    "feedback": """
      select event_id, user_id as agent, ts, event_id % 97 as memory_id, event_type = 'purchase' as useful from events where event_type in ('purchase', 'error')""",
    "tasks": """
      select o_orderkey as id, o_custkey as agent, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'in_progress' end as status,
        cast(substr(o_orderpriority, 1, 1) as int) as priority, o_orderdate as created_at, o_totalprice as cost,
        case when o_orderkey % 7 = 0 then o_orderkey - 1 end as blocked_by from orders""",
    "agents": """
      select c.c_custkey as id, c.c_name as name, r.r_name as workspace, c.c_mktsegment as role, c.c_acctbal as balance,
        case when c.c_custkey % 10 = 0 then 'dead' when c.c_custkey % 3 = 0 then 'working' else 'idle' end as status
      from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey""",
    "findings": """
      select event_id as id, user_id as agent, ts as created_at,
        case when value >= 150 then 'critical' when value >= 80 then 'error' when value >= 30 then 'warn' else 'info' end as severity,
        case when event_id % 3 = 0 then 'resolved' else 'open' end as status, 'cat' || cast(event_id % 4 as STR) as category
      from events where event_type = 'error'""",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations", "pages")


def _render(name: str, dialect: str) -> str:
    out = VIEWS[name]
    for k, v in _DIALECT[dialect].items():
        out = re.sub(rf"{k}\(((?:[^()]|\([^()]*\))*)\)", lambda m, v=v: v % m[1], out) if "%s" in v else re.sub(rf"\b{k}\b", v, out)
    return out


EDGE_ROWS = 250_000  # lineitems to a part of the edges
BROADCAST_ORDERS, LINES = 100_000, 7  # orders sent to every task at most, and lines that an order has about


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of edges in parts whose number grows with the table: joined by order, then grouped in parts by source, so that
    a task holds a bounded number of edges and what follows by source needs no other shuffle."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _paired(items, max(spark.sparkContext.defaultParallelism, -(-items.count() // EDGE_ROWS)))  # from the footers


def edges_at(spark: SparkSession, sf_dir: str, ids: list) -> DataFrame:
    """The rows of the view of edges with an end among a few ids.

    All orders that such a row counts hold one of these parts, so no other order is joined or shuffled."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = items.where(F.col("l_partkey").isin(ids)).select("l_orderkey").distinct()
    n = orders.count()
    own = items.join(F.broadcast(orders) if n <= BROADCAST_ORDERS else orders, "l_orderkey", "left_semi")
    parts = max(spark.sparkContext.defaultParallelism, -(-min(LINES * n, items.count()) // EDGE_ROWS))
    return _paired(own, parts).where(F.col("src").isin(ids) | F.col("dst").isin(ids))


def _paired(items: DataFrame, parts: int) -> DataFrame:
    a = items.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_shipdate").alias("shipped")).repartition(parts, "l_orderkey")
    b = items.select("l_orderkey", F.col("l_partkey").alias("dst")).repartition(parts, "l_orderkey")
    pairs = a.join(b, "l_orderkey").where("src < dst").select("src", "dst", "shipped").repartition(parts, "src")
    sql = re.sub(r"from lineitem a join .* and a\.l_partkey < b\.l_partkey", "from {pairs}", _render("edges", "spark"))
    for old, name in (("a.l_partkey", "src"), ("b.l_partkey", "dst"), ("a.l_shipdate", "shipped")):
        sql = sql.replace(old, name)
    return items.sparkSession.sql(sql, pairs=pairs)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view, or a driver table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "edges":
        return _edges(spark, sf_dir)
    sql = _render(name, "spark")
    tables = [t for t in _BASE if re.search(rf"\b(?:from|join) {t}\b", sql)]
    return spark.sql(re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duckdb_sql(body: str) -> str:
    """The body with the canonical views it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ", ".join(f"{v} as ({_render(v, 'duckdb')})" for v in used)
    body = body.strip()
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
