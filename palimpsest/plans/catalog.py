"""Every registered query of the engine: a DataFrame form and the same in DuckDB SQL.

Queries run over their whole tables.  Where a limit stands in a query, it is the
query's own (top-k, next task, feed page).  ``_all`` names the form over every text, or with
the real best match, of a query whose SQL can't follow there.  Floats are rounded where sums
are taken in different orders, or compared in single precision where exact halves occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import RecallConfig
from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import aggregates as A
from palimpsest.operators import consolidate as C
from palimpsest.operators import coordination as K
from palimpsest.operators import expansion as E
from palimpsest.operators import graph as G
from palimpsest.operators import models as MO
from palimpsest.operators import search as Q
from palimpsest.operators import nearest as N
from palimpsest.operators import stemmed as ST
from palimpsest.operators import windows as W
from palimpsest.operators import write as M
from palimpsest.plans import recall as R
from palimpsest.plans import recall_many as RM
from palimpsest.sources import exchange as X
from palimpsest.sources import migrate as MG
from palimpsest.sources.shared import Scratch, shared_dir
from palimpsest.streaming import operators as SO
from palimpsest.streaming import stateful as SS
from palimpsest.views import AS_OF, duckdb_sql, edges_at, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_NOW = f"timestamp '{AS_OF}'"
SEARCH = "the with from that reation haused"


class Tables:
    """Canonical views by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self._dir, name)

    def edges_at(self, ids: list) -> DataFrame:
        return edges_at(self.spark, self._dir, ids)

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    @property
    def agent_vectors(self) -> DataFrame:
        return self.vectors.join(self.memories.select("id", "agent"), "id")

    def query_vector(self, i: int = 0) -> list[float]:
        return [float(x) for x in self.embeddings.where(F.col("vec_id") == i).select("embedding").first()[0]]


def _fresh(t: Tables, what: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(t.spark)}/palimpsest/{what}-{uuid.uuid4().hex}"


def _index(t: Tables) -> str:
    """A fresh inverted index of all memories."""
    path = _fresh(t, "index")
    Q.store_index(t.memories, path)
    return path


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], None]:
    def add(f: Callable[[Tables], DataFrame]) -> None:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = duckdb_sql(sql)

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def now():
    return F.lit(AS_OF).cast("timestamp")


def epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")


def r6(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


LIVE = "stage = 'active' and not retracted"

# Scans.

query("s1_scan_by_agent", "select id, agent, stage from memories where agent = 'en' and stage = 'active' and not retracted")(lambda t: Q.by_agents(t.memories, ["en"], "active").select("id", "agent", "stage"))
query("s2_scan_by_agents", "select id, agent from memories where agent in ('fr', 'de') and not retracted")(lambda t: Q.by_agents(t.memories, ["fr", "de"]).select("id", "agent"))
query("s3_slim_scan", "select m.id, m.agent, m.concept, e.vec_id is not null as has_vector from memories m left join embeddings e on e.vec_id = m.id")(lambda t: Q.slim(t.memories, t.vectors).select("id", "agent", "concept", F.col("vector").isNotNull().alias("has_vector")))
query("s4_point_lookup", "select id, concept, stage from memories where id = 42")(lambda t: t.memories.where("id = 42").select("id", "concept", "stage"))
query("s5_batch_lookup", "select id, concept from memories where id in (select o_orderkey from orders where o_orderstatus = 'F')")(lambda t: Q.by_ids(t.memories, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).select("id", "concept"))

_BM25 = f"""with d as (select id, agent, retracted, stage, list_filter(string_split(regexp_replace(regexp_replace(lower(concept || ' ' || content || ' ' || array_to_string(tags, ' ')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w != '') as w from memories),
  s as (select count(*) as n, avg(len(w)) as mean from d), p as (select id, len(w) as len, unnest(w) as term from d),
  tf as (select id, len, term, count(*) as tf from p where term in ({', '.join(f"'{w}'" for w in SEARCH.split())}) group by all), df as (select term, count(*) as df from tf group by term),
  b as (select id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as bm25 from tf join df using (term), s group by id)"""
query("s6_tx1_bm25", _BM25 + " select id, round(bm25, 6) as bm25, round(bm25 / (1 + bm25), 6) as score from b")(lambda t: Q.bm25(t.memories, SEARCH).select("id", r6("bm25", "bm25"), r6("score", "score")))
query("s6_stored_index", _BM25 + " select id, round(bm25, 6) as bm25, round(bm25 / (1 + bm25), 6) as score from b")(lambda t: Q.indexed_bm25(t.spark, _index(t), SEARCH).select("id", r6("bm25", "bm25"), r6("score", "score")))
query("j1_top_then_join", _BM25 + ", top as (select id, bm25 from b order by round(bm25, 9) desc, id limit 100) select id, round(bm25, 6) as bm25 from top join memories using (id) where not retracted and agent in ('en', 'es') order by round(bm25, 9) desc, id limit 20")(
    lambda t: Q.bm25_top_then_join(t.memories, SEARCH, ["en", "es"], 20, strict_inner_limit=True).select("id", r6("bm25", "bm25"))
)
_COS = "list_dot_product(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"
query("s7_v2_vector_top", f"select vec_id as id, round({_COS}, 5) as similarity from embeddings join memories on id = vec_id where stage in ('active', 'fading') and not retracted order by round({_COS}, 5) desc, vec_id limit 50")(
    lambda t: Q.vector_top(t.memories, t.vectors, t.query_vector(), 50).select("id", F.round("similarity", 5).alias("similarity"))
)
_HUNDREDTH = "vec_id % 100 = 0"  # a search's queries, against all rows
query("v6_exact_search", f"with q as (select vec_id as query, cast(embedding as double[]) as v from embeddings where {_HUNDREDTH}), s as (select query, vec_id as id, round(list_dot_product(v, cast(embedding as double[])), 5) as similarity from q join embeddings on vec_id != query) select query, id, similarity, row_number() over (partition by query order by similarity desc, id) as rank from s qualify rank <= 10")(
    lambda t: N.exact(_vector_queries(t), t.vectors).select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))
)
query("v6_list_search")(lambda t: N.probed(t.spark, _lists(t), _vector_queries(t)).select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank")))
# with every list probed the inverted file must find what the exact search does
query("v6_list_search_whole", _SQL["v6_exact_search"])(lambda t: N.probed(t.spark, _lists(t), _vector_queries(t), probes=1 << 30).select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank")))


def _vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.where(_HUNDREDTH).select(F.col("vec_id").alias("query"), F.col("vec_id").alias("self"), F.col("embedding").alias("vector"))


def _lists(t: Tables) -> str:
    """A fresh inverted file of all vectors."""
    path = _fresh(t, "lists")
    N.store_lists(t.vectors, path)
    return path


query("v1_cosine", f"select vec_id as id, round(greatest(-1, least(1, {_COS})), 5) as similarity from embeddings")(lambda t: t.vectors.select("id", F.round(V.cosine(F.col("vector"), F.array(*map(F.lit, t.query_vector()))), 5).alias("similarity")))
query("v3_vector_match", f"with s as (select vec_id as id, round({_COS}, 5) as s from embeddings) select id, round(case when s > 0.35 then least(1.0, (s - 0.35) / 0.6) else 0 end, 6) as vector_match from s")(
    lambda t: t.vectors.select("id", F.round(V.cosine(F.col("vector"), F.array(*map(F.lit, t.query_vector()))), 5).alias("s")).select("id", r6(S.vector_match("s", 0.35), "vector_match"))
)
query("s9_export", "with m as (select * from memories where agent = 'en' and not retracted) select src, dst, type, round(weight, 6) as weight from edges where src in (select id from m) and dst in (select id from m)")(lambda t: X.exported(t.memories, t.edges, "en")[1].select("src", "dst", "type", r6("weight", "weight")))
query("s10_export_active", "select id, agent, concept from memories where stage = 'active' and not retracted")(lambda t: X.exported(t.memories.where("stage = 'active'"), t.edges)[0].select("id", "agent", "concept"))
query("s12_merge_sources", """with s as (select 0 as source_no, * from memories where agent = 'en' and not retracted union all select 1, * from memories where not retracted),
  k as (select *, sha256(lower(trim(concept || chr(10) || content))) as key from s), x as (select sha256(lower(trim(concept || chr(10) || content))) as key from memories where agent = 'fr')
  select key, source_no, id from k where key not in (select key from x) qualify row_number() over (partition by key order by source_no, id) = 1""")(  # fmt: skip
    lambda t: X.merged(t.memories.where("agent = 'fr'"), [t.memories.where("agent = 'en'"), t.memories]).select("key", "source_no", "id")
)


def _migrated(t: Tables) -> DataFrame:
    """Memories with vectors, encoded as a row store keeps them, through a whole migration of memories and edges."""

    @F.arrow_udf("binary")
    def packed(vectors):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    own = t.memories.join(t.vectors, "id", "left").withColumn("vector", packed("vector")).withColumn("retracted", F.col("retracted").cast("int"))
    rows = {"memories": own.withColumn("tags", F.to_json("tags")).withColumn("created_at", F.unix_millis(F.col("created_at").cast("timestamp"))), "edges": t.edges.withColumn("last_activated", F.col("last_activated").cast("string"))}
    with Scratch(t.spark) as scratch:  # the source is read for each wave's copy and its digest: made once, ranges reach its scan
        rows = {n: scratch.stored(df, n) for n, df in rows.items()}
        m = MG.Migration(t.spark, _fresh(t, "migrated"), rows, {n: MG.TABLES[n] for n in rows}, rows_per_chunk=250_000)
        m.run()
        degree = m.load("edges").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_edges"), F.max(F.unix_micros("last_activated")).alias("last_us"))
        own = m.load("memories")
    return own.join(degree, "id", "left").select("id", "agent", "stage", "retracted", F.array_join("tags", "|").alias("tags"), F.size("vector").alias("width"), F.get("vector", F.lit(0)).alias("first"), F.unix_micros("created_at").alias("created_us"), "n_edges", "last_us")


query("s13_migrated", "with g as (select src, count(*) as n_edges, max(epoch_us(last_activated::timestamp)) as last_us from edges group by 1) select m.id, agent, stage, retracted, array_to_string(tags, '|') as tags, case when e.embedding is null then null else len(e.embedding)::int end as width, e.embedding[1]::float as first, epoch_us(created_at) as created_us, n_edges, last_us from memories m left join embeddings e on e.vec_id = m.id left join g on g.src = m.id")(_migrated)


query("s14_transcript", """with r as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
  select conv_id as session, substr(min_by(text, case when role = 'user' then rn end), 1, 200) as last_user from r where rn <= 100 group by conv_id""")(
    lambda t: X.transcript_summary(t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), "role", "text", F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("tool"))).select("session", "last_user")
)
query("s15_log_counts", """with l as (select strftime(ts, '%Y-%m-%d') as day, case when event_type like '%purchase%' then 'write' when event_type in ('view', 'click') then 'recall' when event_type = 'signup' then 'hook' end as kind from events)
  select day, count(*) filter (kind = 'write') as write, count(*) filter (kind = 'recall') as recall, count(*) filter (kind = 'restore') as restore, count(*) filter (kind = 'hook') as hook, count(*) filter (kind = 'checkpoint') as checkpoint from l where kind is not null group by day""")(
    lambda t: X.log_counts(t.events.select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type").isin("view", "click"), "recall").when(F.col("event_type") == "signup", "hook").otherwise("-")).alias("value")))
)
query("s16_token_audit", """with u as (select case role when 'user' then 'memory' when 'assistant' then 'writing' else 'other' end as category, length(text) as tokens from conversations)
  select category, count(*) as calls, sum(tokens)::bigint as tokens, round(sum(tokens) / sum(sum(tokens)) over (), 6) as share from u group by category""")(
    lambda t: X.token_audit(t.conversations.select(F.when(F.col("role") == "user", "recall").when(F.col("role") == "assistant", "edit").otherwise("-").alias("tool"), F.length("text").cast("long").alias("tokens"))).select("category", "calls", "tokens", r6("share", "share"))
)
query("s17_prometheus", """select 0 as line_no, '# HELP agents_total agents by status' as line union all select 1, '# TYPE agents_total gauge'
  union all select 2, 'agents_total{status="' || status || '"} ' || count(*) from agents group by status""")(lambda t: K.prometheus(t.agents.groupBy("status").agg(F.count("*").alias("n")), "agents_total", ("status",), "n", "agents by status"))

# Predicates, sorts, limits.

query("p1_search", "select id from memories where (lower(content) like '%the%' or lower(concept) like '%the%') and stage = 'active' and not retracted")(lambda t: Q.search(t.memories, text="the", stage="active", retracted=False, limit=None).select("id"))
query("p2_tags_all", "select id from memories where list_has_all(tags, ['lang=en', 'topic=t3'])")(lambda t: Q.search(t.memories, all_of=["lang=en", "topic=t3"], limit=None).select("id"))
query("p3_tags_any", "select id from memories where list_has_any(tags, ['topic=t1', 'kind=k2'])")(lambda t: Q.search(t.memories, any_of=["topic=t1", "kind=k2"], limit=None).select("id"))
query("p4_tags_none", "select id from memories where not list_has_any(tags, ['topic=t1', 'kind=k2'])")(lambda t: Q.search(t.memories, none_of=["topic=t1", "kind=k2"], limit=None).select("id"))
query("p5_tag_lookup", "select id from memories where not retracted and list_has_any(tags, ['topic=t2']) and id not in (select vec_id from embeddings where label = 1)")(
    lambda t: Q.with_any_tag(t.memories, ["topic=t2"], t.embeddings.where("label = 1").select(F.col("vec_id").alias("id"))).select("id")
)
query("p6_active_by_concept", """select agent, id, lower(trim(concept)) as key from memories where stage = 'active' and not retracted and superseded_by is null
  qualify row_number() over (partition by agent, lower(trim(concept)) order by created_at desc, id) = 1""")(lambda t: Q.active_by_concept(t.memories, t.memories.select("agent", "concept")).select("agent", "id", F.lower(F.trim("concept")).alias("key")))
query("p8_tasks", "select id, task_status, task_priority from memories where task_status is not null and task_status != 'done' and not retracted")(lambda t: t.memories.where("task_status is not null and task_status != 'done' and not retracted").select("id", "task_status", "task_priority"))
query("p9_expired_staging", f"select id from memories where stage = 'staging' and ttl_ms > 0 and created_at + to_milliseconds(ttl_ms) < {_NOW}")(lambda t: M.expired_staging(t.memories, now()).select("id"))
query("p10_stale_working", f"select id from memories where memory_class = 'working' and salience < 0.3 and access_count < 2 and last_accessed < {_NOW} - to_days(90) and superseded_by is null and agent not in ('fr')")(lambda t: C.stale_working(t.memories, now(), ("fr",)).select("id"))
query("p10_cascade", f"with g as (select id from memories where memory_class = 'working' and salience < 0.3 and access_count < 2 and last_accessed < {_NOW} - to_days(90) and superseded_by is null) select count(*) as n from edges where src not in (select id from g) and dst not in (select id from g)")(
    lambda t: C.without_ends(t.edges, C.stale_working(t.memories, now())).agg(F.count("*").alias("n"))
)
query("p11_purge", "select id from memories where not (agent like 'd%' or (salience < 0.2 and agent != 'en'))")(lambda t: t.memories.where(~(F.col("agent").startswith("d") | ((F.col("salience") < 0.2) & (F.col("agent") != "en")))).select("id"))
query("p12_findings", "select id, severity from findings where category = 'cat1' and status = 'open'")(lambda t: t.findings.where("category = 'cat1' and status = 'open'").select("id", "severity"))
query("p13_workspace", "select id from (select id, case when id % 4 = 0 then null else workspace end as w from agents) where w = 'EUROPE' or w is null")(lambda t: t.agents.withColumn("w", F.when(F.col("id") % 4 != 0, F.col("workspace"))).where(K.in_workspace("w", "EUROPE")).select("id"))
query("p14_is_blocked", "select t.id, t.blocked_by is not null and d.id is null as is_blocked from tasks t left join tasks d on d.id = t.blocked_by and d.status = 'completed'")(lambda t: K.blocked(t.tasks).select("id", "is_blocked"))
query("t1_sort_limit", "select id, salience from memories order by salience desc nulls last, id limit 50 offset 10")(lambda t: Q.search(t.memories, sort="salience", limit=50, offset=10).select("id", "salience"))
query("t2_sequence_nulls_last", "select id, sequence from memories order by sequence asc nulls last, id limit 40")(lambda t: Q.search(t.memories, sort="sequence", descending=False, limit=40).select("id", "sequence"))
_PRIO = "case task_priority when 'urgent' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
query("t4_priority_order", f"select id, row_number() over (order by {_PRIO}, created_at desc, id) as position from memories where task_status is not null and not retracted order by {_PRIO}, created_at desc, id limit 100")(
    lambda t: t.memories.where("task_status is not null and not retracted").orderBy(K.ranked_by("task_priority", ("urgent", "high", "medium", "low")), F.desc("created_at"), "id").limit(100).select("id", F.row_number().over(W.Window.orderBy(K.ranked_by("task_priority", ("urgent", "high", "medium", "low")), F.desc("created_at"), "id")).cast("long").alias("position"))
)
query("t5_next_task", f"select id from memories where task_status in ('open', 'in_progress') and not retracted order by task_status != 'in_progress', {_PRIO}, created_at, id limit 1")(
    lambda t: t.memories.where("task_status in ('open', 'in_progress') and not retracted").orderBy(F.col("task_status") != "in_progress", K.ranked_by("task_priority", ("urgent", "high", "medium", "low")), "created_at", "id").limit(1).select("id")
)
_EVICT = f"0.3 * salience + 0.3 * confidence + 0.2 * access_count / (access_count + 5) + 0.2 / (1 + (epoch_us({_NOW}) - epoch_us(last_accessed)) / 86400e6)"
query("t6_m14_eviction", f"with s as (select id, agent, round({_EVICT}, 9) as s from memories where {LIVE}) select id, agent, round(s, 6) as score from s qualify row_number() over (partition by agent order by s desc, id desc) > 100")(
    lambda t: M.evicted(t.memories, now(), 100).select("id", "agent", r6("score", "score"))
)
_QUEUE = "q as (select id, case when id % 3 != 0 then agent end as agent, case id % 4 when 0 then 'EUROPE' when 1 then 'ASIA' end as workspace, status, 6 - priority as priority, created_at, blocked_by from tasks)"
query("t7_dispatch", f"""with {_QUEUE}, f as (select q.* from q left join q d on d.id = q.blocked_by and d.status = 'completed' where q.status = 'pending' and (q.blocked_by is null or d.id is not null)),
  best as (select * from f where agent is null qualify row_number() over (partition by workspace order by priority desc, created_at, id) = 1),
  c as (select a.id as agent, f.id, f.priority, f.created_at, 1 as step from agents a join f on f.agent = a.id union all select a.id, b.id, b.priority, b.created_at, 2 from agents a join best b on b.workspace = a.workspace or b.workspace is null)
  select agent, id, priority from c qualify row_number() over (partition by agent order by step, priority desc, created_at, id) = 1""")(lambda t: K.next_for_agents(_queue(t), t.agents))
query("t8_severity_order", "select id, severity from findings order by case severity when 'critical' then 0 when 'error' then 1 when 'warn' then 2 else 3 end, created_at desc, id limit 50")(lambda t: t.findings.orderBy(K.ranked_by("severity", ("critical", "error", "warn")), F.desc("created_at"), "id").limit(50).select("id", "severity"))


def _queue(t: Tables) -> DataFrame:
    """Tasks of which a third is reserved for nobody, some of them in a workspace; 5 is the most urgent."""
    return t.tasks.select("id", F.when(F.col("id") % 3 != 0, F.col("agent")).alias("agent"), F.when(F.col("id") % 4 == 0, "EUROPE").when(F.col("id") % 4 == 1, "ASIA").alias("workspace"), "status", (6 - F.col("priority")).alias("priority"), "created_at", "blocked_by")


def _commands(events: DataFrame) -> DataFrame:
    return events.where("event_type in ('signup', 'error', 'purchase')").select(F.col("event_id").alias("id"), "ts", F.when(F.col("user_id") % 3 == 1, "a").when(F.col("user_id") % 3 == 2, "b").alias("workspace"), F.when((F.col("event_type") == "signup") & (F.col("event_id") % 40 == 0), "RESUME").when(F.col("event_type") == "signup", "BUILD_FREEZE").when(F.col("event_type") == "error", "SHUTDOWN").otherwise("PAUSE").alias("command"))


query("t9_k6_commands", """with c as (select event_id as id, ts, case user_id % 3 when 0 then null when 1 then 'a' else 'b' end as workspace, case when event_type = 'signup' and event_id % 40 = 0 then 'RESUME' when event_type = 'signup' then 'BUILD_FREEZE' when event_type = 'error' then 'SHUTDOWN' when event_type = 'purchase' then 'PAUSE' end as command from events where event_type in ('signup', 'error', 'purchase')),
  r as (select workspace, max(ts) as m from c where command = 'RESUME' and workspace is not null group by 1), a as (select max(ts) as m from c where command = 'RESUME' and workspace is null)
  select id, command from c left join r on c.workspace = r.workspace cross join a where command != 'RESUME' and (r.m is null or ts > r.m) and (a.m is null or ts > a.m)""")(
    lambda t: K.active_commands(_commands(t.events)).select("id", "command")
)
query("t12_scheduler_pick", "select agent from memories group by agent order by count(*) desc, max(created_at), agent limit 1")(lambda t: t.memories.groupBy("agent").agg(F.count("*").alias("n"), F.max("created_at").alias("m")).orderBy(F.desc("n"), "m", "agent").limit(1).select("agent"))

# Joins and sets.

query("j2_scoped_edges", f"select count(*) as n, round(sum(weight), 4) as w from edges where src in (select id from memories where {LIVE})")(lambda t: G.scoped(t.edges, t.memories.where(LIVE)).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("w")))
_ENDS = "ends as (select src as id, weight from edges union all select dst, weight from edges)"
query("j3_a1_edge_stats", f"with {_ENDS}, s as (select id, count(*) as n, sum(weight) as w from ends group by id) select m.id, coalesce(s.n, 0) as n, round(coalesce(s.w, 0), 6) as sum_weight from memories m left join s using (id)")(lambda t: G.edge_stats(t.edges, t.memories).select("id", "n", r6("sum_weight", "sum_weight")))
query("j4_neighbours", f"with u as (select src as id, dst as other, type from edges union all select dst, src, type from edges where src != dst) select id, other, type from u where id in (select id from memories where task_status = 'open')")(lambda t: G.neighbours(t.edges, t.memories.where("task_status = 'open'")).select("id", "other", "type"))
query("j5_findings_agents", "select f.id, f.severity, a.name from findings f join agents a on a.id = f.agent")(lambda t: t.findings.join(t.agents.select(F.col("id").alias("agent"), "name"), "agent").select("id", "severity", "name"))
query("j6_k9_timeline", "with e as (select event_id, user_id as agent, ts from events order by ts desc, event_id desc limit 50), a as (select id, name, id * 3 as current_task from agents) select e.event_id, a.name, t.status as task_status from e left join a on a.id = e.agent left join tasks t on t.id = a.current_task")(
    lambda t: K.timeline(t.events.select("event_id", F.col("user_id").alias("agent"), "ts"), t.agents.withColumn("current_task", F.col("id") * 3), t.tasks).select("event_id", "name", "task_status")
)
query("j7_a6_precision", "select count(*) as n, round(count(*) filter (useful) / count(*), 6) as precision from feedback where ts > timestamp '2024-01-05' and memory_id in (select id from memories)")(
    lambda t: A.retrieval_precision(t.feedback, t.memories, F.lit("2024-01-05").cast("timestamp")).select("n", r6("precision", "precision"))
)
query("j8_unblocked", "select id from tasks where blocked_by in (select id from tasks where status = 'completed')")(lambda t: K.unblocked(t.tasks).select("id"))
query("j9_keep_latest", "select max(id) as id, workspace, role from agents group by workspace, role")(lambda t: t.agents.groupBy("workspace", "role").agg(F.max("id").alias("id")))
_PAIRS = "with v as (select vec_id as id, cast(embedding as double[]) as v, lang as agent from embeddings join documents on doc_id = vec_id), p as (select a.agent, a.id as a, b.id as b, round(list_dot_product(a.v, b.v), 6) as s from v a join v b on a.agent = b.agent and a.id < b.id)"
query("j10_similar_pairs", _PAIRS + " select agent, a, b, round(s, 5) as similarity from p where s >= 0.35")(lambda t: C.similar_pairs(t.agent_vectors, 0.35).select("agent", "a", "b", F.round(F.round("similarity", 6), 5).alias("similarity")))
query("j11_co_activated", "select least(a.memory_id, b.memory_id) as a, greatest(a.memory_id, b.memory_id) as b, count(*) as n from activations a join activations b on a.agent = b.agent and a.event_id < b.event_id and a.memory_id != b.memory_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 group by 1, 2")(
    lambda t: W.co_activated(t.activations, 3600)
)
query("j12_resolved_feedback", "select f.event_id as feedback_id, f.useful, max_by(a.event_id, epoch_us(a.ts)::hugeint * 1000000 + a.event_id) as activation_id from feedback f join activations a on a.memory_id = f.memory_id and a.ts <= f.ts and epoch_us(f.ts) - epoch_us(a.ts) <= 86400000000 group by 1, 2")(
    lambda t: W.resolved_feedback(t.feedback, t.activations, 86400).select("feedback_id", "useful", "activation_id")
)
query("j13_w4_previous_links", "select src, id as dst, 0.3::double as weight from (select id, lag(id) over (partition by agent order by created_at, id) as src from memories) where src is not null")(lambda t: W.previous_links(t.memories).select("src", "dst", "weight"))
_SESSIONS = "g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g), x as (select user_id as agent, cast(session as bigint) as session, min(ts) as a, max(ts) as b, count(*) as n from s group by 1, 2)"
query("w8_sessions", f"with {_SESSIONS} select agent, session, epoch_us(a) as start_ts_us, epoch_us(b) as end_ts_us, n from x")(lambda t: W.sessions(t.events.withColumnRenamed("user_id", "agent")).select("agent", "session", epoch("start_ts"), epoch("end_ts"), "n"))
query("j14_active_session", f"with {_SESSIONS.replace('from events', 'from events where ts <= timestamp ' + chr(39) + '2024-01-15 12:00:00' + chr(39))} select agent, session, n from x where epoch_us(b) > epoch_us(timestamp '2024-01-15 12:00:00') - 3600000000 qualify row_number() over (partition by agent order by b desc, session desc) = 1")(
    lambda t: W.active_session(t.events.withColumnRenamed("user_id", "agent"), 1_705_320_000_000_000).select("agent", "session", "n")
)
query("j15_w3_effective_state", "with r as (select id as by_id, created_at, unnest(refs) as ref from memories where not retracted), x as (select by_id, created_at, split_part(ref, ':', 1) as state, cast(split_part(ref, ':', 2) as bigint) as id from r) select id, state, by_id as resolved_by from x where state in ('resolves', 'reopens', 'abandons') and id in (select id from memories) qualify row_number() over (partition by id order by created_at desc, by_id desc) = 1")(
    lambda t: Q.effective_state(t.memories)
)
query("j16_peer_decisions", "select d.event_id as id, a.name from events d join agents a on a.id = d.user_id where lower(d.event_type) like '%purchase%' or lower(d.event_type) like '%signup%' order by d.ts desc, d.event_id limit 20")(
    lambda t: K.peer_decisions(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("agent"), "ts", F.col("event_type").alias("text")), t.agents, "When did the purchase or signup happen?", 20).select("id", "name")
)
query("j18_staged_best_match", "with v as (select vec_id as id, cast(embedding as double[]) as v, stage, retracted from embeddings join memories on id = vec_id) select s.id, round(max(round(list_dot_product(s.v, a.v), 6)), 5) as score from v s join v a on s.stage = 'staging' and a.stage = 'active' and not a.retracted group by s.id")(
    lambda t: _staged_best(t)
)
query("u1_endpoints", f"with {_ENDS} select id, count(*) as n from ends group by id")(lambda t: G.endpoints(t.edges).groupBy("id").agg(F.count("*").alias("n")))
query("u2_merged_hits", _BM25 + ", y as (select id, bm25 / (1 + bm25) as s from b union all select id, salience from memories where agent = 'es') select id, round(max(s), 6) as score from y group by id")(
    lambda t: Q.merged_text_hits(Q.bm25(t.memories, SEARCH), t.memories.where("agent = 'es'").select("id", F.col("salience").alias("score"))).select("id", r6("score", "score"))
)
query("u3_hybrid_candidates", _BM25 + f", h as (select id, bm25 / (1 + bm25) as s from b order by round(bm25, 9) desc, id limit 60), v as (select vec_id as id, round({_COS}, 5) as s from embeddings join memories on id = vec_id where stage in ('active', 'fading') and not retracted order by s desc, vec_id limit 60) select coalesce(h.id, v.id) as id, round(coalesce(h.s, 0), 6) as score, v.s as similarity from h full join v on h.id = v.id")(
    lambda t: Q.hybrid_candidates(Q.bm25(t.memories, SEARCH, 60), Q.vector_top(t.memories, t.vectors, t.query_vector(), 60)).select("id", r6("score", "score"), F.round("similarity", 5).alias("similarity"))
)
query("u4_difference", "select id from memories where id not in (select src from edges) and id not in (select dst from edges)")(lambda t: t.memories.join(G.endpoints(t.edges).select("id"), "id", "left_anti").select("id"))


def _staged_best(t: Tables) -> DataFrame:
    live = t.vectors.join(t.memories.select("id", "stage", "retracted"), "id")
    staged = live.where("stage = 'staging'").select(F.col("id").alias("query"), F.col("id").alias("self"), "vector")
    best = N.exact(staged, live.where("stage = 'active' and not retracted").select("id", "vector"), 1, places=6)
    return best.select(F.col("query").alias("id"), F.round(F.round("similarity", 6), 5).alias("score"))


# Aggregates.

query("a2_out_degree", "select src as id, count(*) as degree from edges group by src")(lambda t: G.out_degree(t.edges))
query("a3_weakest_edge", "select src as id, dst, round(weight, 6) as weight from edges qualify row_number() over (partition by src order by weight, dst) = 1")(lambda t: G.weakest(t.edges).select("id", "dst", r6("weight", "weight")))
query("a4_stage_counts", "select agent, count(*) filter (stage = 'active' and not retracted) as active, count(*) filter (stage = 'staging' and not retracted) as staging, count(*) filter (stage = 'consolidated' and not retracted) as consolidated from memories group by agent")(lambda t: A.stage_counts(t.memories))
query("a7_latency", """select agent, count(latency_ms) as n, round(avg(latency_ms), 6) as mean_ms, list_sort(list(latency_ms))[least(cast(floor(0.95 * count(latency_ms)) as bigint), count(latency_ms) - 1) + 1] as p95_ms from activations group by agent""")(
    lambda t: A.latency_stats(t.activations, ["agent"]).select("agent", "n", r6("mean_ms", "mean_ms"), "p95_ms")
)
query("a8_engine_metrics", f"""with m as (select coalesce(avg(confidence) filter ({LIVE}), 0) as c, count(*) filter (retracted) / greatest(count(*) filter ({LIVE}) + count(*) filter (retracted), 1) as r from memories),
  e as (select count(*) filter (activation_count > 0) / count(*) as u, avg((epoch_us({_NOW}) - epoch_us(last_activated)) / 86400e6) filter (weight > 0.01) as d from edges where src in (select id from memories)),
  p as (select count(*) filter (useful) / count(*) as p from feedback where ts > timestamp '2024-01-01' and memory_id in (select id from memories))
  select round(c, 6) as avg_confidence, round(r, 6) as retraction_rate, round(u, 6) as edge_utility, round(d, 4) as mean_edge_age_days, round(p, 6) as precision from m, e, p""")(
    lambda t: A.engine_metrics(t.memories, t.edges, t.feedback, now(), F.lit("2024-01-01").cast("timestamp")).select(r6("avg_confidence", "avg_confidence"), r6("retraction_rate", "retraction_rate"), r6("edge_utility", "edge_utility"), F.round("mean_edge_age_days", 4).alias("mean_edge_age_days"), r6("precision", "precision"))
)
query("a9_agent_stats", f"select agent, count(*) filter ({LIVE}) as active, count(*) filter (stage = 'staging' and not retracted) as staging, count(*) filter (retracted) as retracted, count(*) filter ({LIVE}) + count(*) filter (stage = 'staging' and not retracted) + count(*) filter (retracted) as total, round(coalesce(avg(confidence) filter ({LIVE}), 0), 3) as avg_confidence from memories group by agent")(lambda t: A.agent_stats(t.memories))
query("a10_queue_stats", "select count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'completed') as completed, round(avg(cost), 4) as avg_cost, min(created_at)::date::varchar as since from tasks")(
    lambda t: t.tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(F.avg("cost"), 4).alias("avg_cost"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("since"))
)
query("a11_group_counts", "select severity, category, count(*) as n from findings where status = 'open' group by 1, 2")(lambda t: t.findings.where("status = 'open'").groupBy("severity", "category").agg(F.count("*").alias("n")))
query("a12_dashboard", "select (select count(*) from agents where status != 'dead') as alive, (select count(*) from tasks where status = 'pending') as pending, (select count(*) from findings where status = 'open') as open_findings")(
    lambda t: t.agents.agg(F.count_if(F.col("status") != "dead").alias("alive")).join(t.tasks.agg(F.count_if(F.col("status") == "pending").alias("pending"))).join(t.findings.agg(F.count_if(F.col("status") == "open").alias("open_findings")))
)
query("a14_centroids", "with f as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) select label, pos, round(avg(x::double), 5) as x from f group by 1, 2")(
    lambda t: A.centroids(t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("vector")), "label").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))
)
query("a15_degree_quartile", "with d as (select src, count(*) as degree from edges group by src) select list_sort(list(degree))[least(cast(floor(0.25 * count(*)) as bigint), count(*) - 1) + 1] as quartile, count(*) as n from d")(lambda t: A.nearest_rank(G.out_degree(t.edges), "degree", 0.25, name="quartile").select("quartile", F.col("n").cast("long").alias("n")))
query("a16_next_sequence", "select agent, coalesce(max(sequence), 0) + 1 as next_sequence from memories group by agent")(lambda t: A.next_sequence(t.memories))
query("a17_distinct_names", "select distinct workspace, role from agents")(lambda t: t.agents.select("workspace", "role").distinct())
query("a18_consensus_tags", "with u as (select src as id, dst as other from edges union select dst, src from edges), x as (select distinct id as other, unnest(tags) as tag from memories), n as (select u.id, tag, count(*) as n from u join x using (other) group by 1, 2 having count(*) >= 2) select id, tag, n from n qualify row_number() over (partition by id order by n desc, tag) <= 5")(lambda t: A.consensus_tags(t.memories, t.edges))
query("a19_purge_preview", "select agent, count(*) as n, round(avg(salience), 2) as avg_salience from memories group by agent order by n desc, agent limit 20")(lambda t: A.purge_preview(t.memories))
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
query("a13_term_counts", f"with w as (select agent, unnest(string_split(regexp_replace(regexp_replace(lower(regexp_replace(content, '[^a-zA-Z0-9_\\s]', '', 'g')), '\\s+', ' ', 'g'), '^ | $', '', 'g'), ' ')) as word from memories), c as (select agent, word, count(*) as n from w where length(word) > 3 and word not in ({_STOP}) group by 1, 2) select agent, word, n from c qualify row_number() over (partition by agent order by n desc, word) <= 15")(
    lambda t: A.term_counts(t.memories, "agent").select("agent", "word", "n")
)

# Windows.

query("w1_latest_by_tag", f"select list_filter(tags, lambda x: starts_with(x, 'topic='))[1][7:] as value, id from memories where {LIVE} qualify row_number() over (partition by value order by created_at desc, id) = 1")(lambda t: Q.latest_by_tag(t.memories, "topic=").select("value", "id"))
query("w1_latest_by_sequence", f"select list_filter(tags, lambda x: starts_with(x, 'topic='))[1][7:] as value, id from memories where {LIVE} and sequence is not null qualify row_number() over (partition by value order by sequence desc, created_at desc, id) = 1")(lambda t: Q.latest_by_tag(t.memories, "topic=", "sequence").select("value", "id"))
query("w2_top_by_tag", f"select id, cast(list_filter(tags, lambda x: starts_with(x, 'weight='))[1][8:] as double) as number from memories where {LIVE} and list_contains(tags, 'lang=en') order by number desc nulls last, id limit 50")(lambda t: Q.top_by_tag(t.memories, "weight=", 50, all_of=["lang=en"]).select("id", "number"))
query("w5_recall_confidence", """with r as (select user_id % 50 as query, 1 / (1 + exp(-value / 100)) as s, row_number() over (partition by user_id % 50 order by 1 / (1 + exp(-value / 100)) desc, event_id) as rank from events),
  g as (select query, max(s) filter (rank = 1) as top, avg(s) filter (rank <= 5) as m, max_by(s, rank) as last, count(*) as n from r where rank <= 10 group by query),
  p as (select query, case when n >= 2 and m > 0 then (top / m - 1) / (top / m + 1) else 0 end as a, case when n >= 2 and top > 0 then greatest(0, least(1, (top - last) / top)) else 0 end as b, greatest(0, least(1, top)) as c from g)
  select query, round(greatest(0, least(1, exp(0.4 * ln(a + 0.05) + 0.3 * ln(b + 0.05) + 0.3 * ln(c + 0.05)) - 0.05)), 6) as confidence from p""")(
    lambda t: W.recall_confidence(
        t.events.select((F.col("user_id") % 50).alias("query"), "event_id", S.sigmoid(F.col("value") / 100).alias("score")).withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "event_id")))
    ).select("query", r6("confidence", "confidence"))
)
query("w6_e4_spearman", "with r as (select event_type, row_number() over (partition by event_type order by value, event_id) as x, row_number() over (partition by event_type order by user_id, event_id) as y from events) select event_type, round(case when count(*) < 2 then 0 else 1 - 6 * sum((x - y) * (x - y)) / (count(*)::double * (count(*) * count(*) - 1)) end, 6) as rho from r group by 1")(
    lambda t: A.spearman(t.events.withColumn("id", F.col("event_id")), "value", "user_id", ["event_type"]).select("event_type", r6("rho", "rho"))
)
query("w7_rate_limit", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as in_window from events")(lambda t: W.rate_limited(t.events.withColumnRenamed("user_id", "agent"), seconds=86400, most=5).select("event_id", "in_window"))
query("w10_failure_runs", "with g as (select *, sum((event_type != 'error')::int) over (partition by user_id order by ts, event_id) as g from events) select event_id, cast(sum((event_type = 'error')::int) over (partition by user_id, g order by ts, event_id) as bigint) as failures from g")(
    lambda t: W.failure_runs(t.events.withColumnRenamed("user_id", "agent").withColumn("ok", F.col("event_type") != "error")).select("event_id", "failures")
)
query("w11_heaviest_edges", "select src, dst, round(weight, 6) as weight from edges qualify row_number() over (partition by src order by weight desc, dst) <= 20")(lambda t: G.heaviest(t.edges, 20).select("src", "dst", r6("weight", "weight")))
query("w9_coalesced_pulses", """with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  r as (select user_id, rn, event_id, t as kept, true as keep from e where rn = 1
    union all select e.user_id, e.rn, e.event_id, case when e.t - r.kept >= 86400000000 then e.t else r.kept end, e.t - r.kept >= 86400000000 from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
  select user_id as agent, event_id from r where keep""")(lambda t: W.coalesced(t.events.withColumnRenamed("user_id", "agent"), seconds=86400))
query("k7_breaker", """with recursive e as (select event_id, user_id, epoch_us(ts) as t, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  r as (select user_id, rn, event_id, 'closed' as state, bad::int as failures, null::bigint as opened from e where rn = 1
    union all select e.user_id, e.rn, e.event_id, case when r.failures < 2 then 'closed' when e.t - r.opened > 86400000000 then 'half_open' else 'open' end, case when e.bad then r.failures + 1 else 0 end,
      case when not e.bad or r.failures + 1 < 2 then null when r.failures < 2 or e.t - r.opened > 86400000000 then e.t else r.opened end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
  select event_id, state from r""")(
    lambda t: W.breaker_states(t.events.withColumnRenamed("user_id", "agent").withColumn("ok", F.col("event_type") != "error"), threshold=2, cooldown_seconds=86400).select("event_id", "state")
)

# Scoring functions.

_AGE = f"(epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6"
_IDLE = f"(epoch_us({_NOW}) - epoch_us(last_accessed)) / 86400e6"
_EDGE_DAYS = f"(epoch_us({_NOW}) - epoch_us(last_activated)) / 86400e6"


def _age():
    return S.days_between(now(), F.col("created_at"))


def _idle():
    return S.days_between(now(), F.col("last_accessed"))


query("f1_base_level", f"select id, round(ln(access_count + 1) - 0.5 * ln(greatest({_AGE}, 0.001) / (access_count + 1)), 6) as base from memories")(lambda t: t.memories.select("id", r6(S.base_level("access_count", _age()), "base")))
query("f2_softplus", "select event_id, round(ln(1 + exp(value / 50 - 2)), 6) as y from events where value / 50 - 2 < 300")(lambda t: t.events.where("value / 50 - 2 < 300").select("event_id", r6(S.softplus(F.col("value") / 50 - 2), "y")))
query("f3_composite", f"select id, round(salience * ln(1 + exp(ln(access_count + 1) - 0.5 * ln(greatest({_AGE}, 0.001) / (access_count + 1)) + 0.3)) * confidence, 6) as score from memories")(lambda t: t.memories.select("id", r6(S.composite_score("salience", S.base_level("access_count", _age()), 0.3, "confidence"), "score")))
query("f4_strengthen", "select src, dst, cast(least(exp(ln(greatest(weight, 0.001)) + ln(1.25)), 5) as float) as weight from edges")(lambda t: t.edges.select("src", "dst", S.strengthen("weight").cast("float").alias("weight")))
query("f5_decay_edge", f"select src, dst, round(greatest(weight * power(1 + {_EDGE_DAYS} / 7, -0.8), 0.001), 6) as weight from edges")(lambda t: t.edges.select("src", "dst", r6(S.decay_edge("weight", S.days_between(now(), F.col("last_activated"))), "weight")))
query("f6_touch", "select id, round(least(0.85, least(0.85, confidence + 0.02 / (1 + sqrt(access_count))) + 0.02 / (1 + sqrt(access_count + 1))), 6) as confidence from memories")(lambda t: t.memories.select("id", r6(S.touched_confidence("confidence", "access_count", 2), "confidence")))
query("f7_feedback", "select id, round(greatest(0, least(1, confidence + case when id % 2 = 0 then 0.05 else -0.1 end)), 6) as confidence from memories")(lambda t: t.memories.select("id", r6(S.with_feedback("confidence", F.col("id") % 2 == 0), "confidence")))
query("f8_archive_days", "select id, round(least(30 * (1 + 0.6 * ln(1 + access_count)) * (1 + 3 * greatest(0, (confidence - 0.5) / 0.5)), 360), 6) as days from memories")(lambda t: t.memories.select("id", r6(S.archive_after_days("access_count", "confidence"), "days")))
query("f9_half_life", "select id, round(least(7 * (1 + 2 * greatest(0, (confidence - 0.5) / 0.5)) * least(2, 1 + 0.5 * ln(1 + access_count)), 42), 6) as days from memories")(lambda t: t.memories.select("id", r6(S.edge_half_life("confidence", "access_count"), "days")))
query("f10_access_factor", "select id, round(least(1, 0.3 + 0.7 * ln(1 + access_count + id % 7) / ln(21)), 6) as af from memories")(lambda t: t.memories.select("id", r6(S.access_factor("access_count", F.col("id") % 7), "af")))
query("f11_sigmoid", "select event_id, round(1 / (1 + exp(-value / 100)), 6) as y from events")(lambda t: t.events.select("event_id", r6(S.sigmoid(F.col("value") / 100), "y")))
query("f12_saturate", "select event_id, round(value / (1 + value), 6) as y from events")(lambda t: t.events.select("event_id", r6(S.saturate("value"), "y")))
query("f13_novelty", "select id, round(case when id % 5 = 0 then 1 else greatest(0.05, least(0.95, 1 - salience * salience - case when id % 2 = 0 then 0.3 else 0 end)) end, 6) as novelty from memories")(lambda t: t.memories.select("id", r6(S.novelty(F.when(F.col("id") % 5 != 0, F.col("salience")), F.col("id") % 2 == 0), "novelty")))
query("r3_text_match", "select event_id, round(case when k > 0 and v > 0 then 0.5 * greatest(k, v) + 0.3 * least(k, v) + 0.2 * k * v else greatest(k, v) end, 6) as y from (select event_id, case when event_id % 3 = 0 then 0 else least(1, value / 100) end as k, (event_id % 10) / 10 as v from events)")(
    lambda t: t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100)).alias("k"), ((F.col("event_id") % 10) / 10).alias("v")).select("event_id", r6(S.text_match("k", "v"), "y"))
)
query("r4_decay_exponent", "select id, round(greatest(0.2, 0.5 - 0.2 * greatest(0, (confidence - 0.5) / 0.5) - least(0.1, 0.05 * ln(1 + access_count))), 6) as d from memories")(lambda t: t.memories.select("id", r6(S.decay_exponent(0.5, "confidence", "access_count"), "d")))
query("r5_r6_composite", f"""with {_ENDS}, s as (select id, count(*) as n, sum(weight) as w from ends group by id), m as (select m.*, coalesce(s.n, 0) as n, coalesce(s.w, 0) as w from memories m left join s using (id)),
  x as (select *, salience as tm, least(case when n > 0 then w / n else 0 end, 0.5) as h, case when n > 0 then least(0.1, 0.03 * ln(1 + w)) else 0 end as ce, case when confidence > 0.55 then least(0.15, 0.3 * greatest(0, confidence - 0.5)) else 0 end as fb,
    greatest(0.2, 0.5 - 0.2 * greatest(0, (confidence - 0.5) / 0.5) - least(0.1, 0.05 * ln(1 + access_count))) as d from m),
  y as (select *, least(ln(1 + exp(ln(access_count + 1) - d * ln(greatest({_AGE}, 0.001) / (access_count + 1)) + h)), 3) / 3 as te, case when tm > 0.1 then tm else 0 end as g from x)
  select id, round((0.6 * tm + 0.4 * te * g + ce * g + fb * g) * confidence, 6) as composite from y""")(
    lambda t: t.memories.join(G.edge_stats(t.edges, t.memories), "id").select("id", r6(S.gated_composite("salience", F.least(S.softplus(S.base_level("access_count", _age(), S.decay_exponent(0.5, "confidence", "access_count")) + F.when(F.col("n") > 0, F.least(F.col("sum_weight") / F.col("n"), F.lit(0.5))).otherwise(0.0)), F.lit(3.0)) / 3, S.centrality("n", "sum_weight"), S.feedback_bonus("confidence"), "confidence", 0.6, 0.4), "composite"))
)

# Text functions.

_W = "list_filter(string_split(regexp_replace(lower({c}), '\\s+', ' ', 'g'), ' '), lambda w: length(w) > 2 and w not in (" + _STOP + "))"
query("tx3_tokens", f"select id, list_sort(list_distinct({_W.format(c='content')})) as tokens from memories")(lambda t: t.memories.select("id", F.array_sort(T.tokens(F.col("content"))).alias("tokens")))
query("tx4_u5_jaccard", f"with x as (select id, list_distinct({_W.format(c='concept')}) as a, list_distinct({_W.format(c='content')}) as b, list_distinct({_W.format(c=repr(SEARCH))}) as q from memories) select id, round(0.6 * case when len(a) > 0 then len(list_intersect(q, a)) / (len(q) + len(a) - len(list_intersect(q, a))) else 0 end + 0.4 * case when len(b) > 0 then len(list_intersect(q, b)) / (len(q) + len(b) - len(list_intersect(q, b))) else 0 end, 6) as score from x")(
    lambda t: t.memories.select("id", r6(T.keyword_score(T.tokens(F.lit(SEARCH)), T.tokens(F.col("concept")), T.tokens(F.col("content"))), "score"))
)
query("tx7_classify", "with x as (select id, concept as c, len(list_filter(string_split(regexp_replace(concept, '\\s+', ' ', 'g'), ' '), lambda w: w != '')) as n from memories), s as (select id, case when n <= 5 then 2 when n <= 8 then 1 else 0 end - case when n > 15 then 2 when n > 10 then 1 else 0 end + case when regexp_matches(c, '[A-Z]+-\\d+') then 2 else 0 end + case when regexp_matches(c, '[a-z][A-Z]') then 1 else 0 end + case when regexp_matches(c, '\\w+_\\w+') then 1 else 0 end + case when regexp_matches(lower(c), '[0-9a-f]{8}-[0-9a-f]{4}') then 2 else 0 end + case when regexp_matches(c, '[\"'']') then 1 else 0 end + case when regexp_matches(c, '[/\\\\]') then 1 else 0 end + case when regexp_matches(trim(c), '\\.\\w{1,4}$') then 1 else 0 end - case when regexp_matches(c, '(?i)^(what|how|why|when|where|who|which|can|does|is|are)\\b') then 1 else 0 end - case when regexp_matches(lower(c), '\\b(overview|general|about|related|similar|like|broad|concept|idea|approach|strategy)\\b') then 1 else 0 end - case when regexp_matches(lower(c), '\\b(any|all|everything|anything)\\b') then 1 else 0 end as s from x) select id, case when s >= 2 then 'targeted' when s <= -2 then 'exploratory' else 'balanced' end as mode from s")(
    lambda t: t.memories.select("id", T.classify_query(F.col("concept")).alias("mode"))
)
query("tx10_auto_tags")(lambda t: t.memories.select("id", T.auto_tags(F.col("concept"), F.col("content")).alias("auto_tags")))
query("tx11_entities", "with e as (select id, list_distinct(list_filter(regexp_extract_all(content, '\\b([A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda x: length(x) <= 40 and x not in (" + ", ".join(f"'{w}'" for w in T.ENTITY_STOPWORDS) + "))) as e from memories where regexp_matches(content, '^[\\x00-\\x7f]*$')) select id, len(e) as n from e")(lambda t: t.memories.where(F.col("content").rlike(r"^[\x00-\x7f]*$")).select("id", F.size(T.entities(F.col("content"))).cast("long").alias("n")))
query("tx11_entities_all")(lambda t: t.memories.select("id", F.size(T.entities(F.col("content"))).cast("long").alias("n")))
query("tx12_detectors", "select id, regexp_matches(content, '" + T.ROUTINE_VERBS + "') and regexp_matches(content, '" + T.ROUTINE_NOUNS + "') and length(trim(content, ' ')) <= 150 as routine from memories")(lambda t: t.memories.select("id", T.is_routine(F.col("content")).alias("routine")))
query("tx13_memory_type", "select id, case when regexp_matches(content, '(?i)\\bhow to\\b|\\bsteps?:') or regexp_matches(content, '(?m)^\\s*\\d+[.)]\\s') or regexp_matches(content, '(?i)\\bthen run\\b|\\bfirst,?\\s') then 'procedural' when regexp_matches(content, '(?i)\\b(discovered|debugged|fixed|encountered|happened|resolved|found that|we did|i did|yesterday|last week|today)\\b') then 'episodic' when regexp_matches(content, '(?i)\\b(is|are|should|always|never|must|uses?|requires?|means|pattern|decision|rule|convention)\\b') and length(content) < 500 then 'semantic' else 'unclassified' end as type from memories")(lambda t: t.memories.select("id", T.memory_type(F.col("content")).alias("type")))
query("tx14_keywords", "select id, list_filter(string_split(regexp_replace(regexp_replace(lower(concept), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: length(w) >= 4 and w not in (" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS) + "))[1:8] as keywords from memories")(lambda t: t.memories.select("id", T.keywords(F.col("concept")).alias("keywords")))
query("tx15_failure_mode", "select event_id, case when r like '%stale%' then 'agent_stale' when r like '%timed out%' then 'timeout' when r like '%schema%' then 'output_invalid' when r like '%conflict%' then 'merge_conflict' else 'unknown' end as mode from (select event_id, case event_id % 6 when 0 then 'worker stale' when 1 then 'it timed out' when 2 then 'bad schema' when 3 then 'merge conflict' when 4 then 'odd' end as r from events)")(
    lambda t: t.events.select("event_id", T.failure_mode(F.expr("case event_id % 6 when 0 then 'Worker STALE' when 1 then 'it timed out' when 2 then 'bad schema' when 3 then 'merge conflict' when 4 then 'odd' end")).alias("mode"))
)
query("tx16_completion_gate", "select id, length(trim(content, ' ')) >= 20 and regexp_matches(content, '" + T.ACTION_WORDS + "') as accepted from memories where regexp_matches(content, '^[\\x00-\\x7f]*$')")(lambda t: t.memories.where(F.col("content").rlike(r"^[\x00-\x7f]*$")).select("id", T.completion_accepted(F.col("content")).alias("accepted")))
query("tx16_completion_gate_all")(lambda t: t.memories.select("id", T.completion_accepted(F.col("content")).alias("accepted")))
query("tx17_merge_content", "with x as (select id, concept as o, trim(substr(content, 100, 80), ' ') as n, substr(content, 1, 1460) as big from memories) select id, case when n = '' or contains(big, n) then big when length(big) + length(n) + 22 <= 1500 then big || chr(10) || chr(10) || '--- reinforced ---' || chr(10) || n else n end as content from x")(
    lambda t: t.memories.select("id", T.merge_content(F.substring("content", 1, 1460), F.substring("content", 100, 80)).alias("content"))
)
# whole contents, each with the next memory's concept as a new segment
query("tx17_merge_content_all")(lambda t: t.memories.join(t.memories.select((F.col("id") - 1).alias("id"), F.col("concept").alias("more")), "id", "left").select("id", T.merge_content(F.col("content"), F.col("more"), M.CONTENT_LIMIT).alias("content")))
query("tx18_fade", "select id, rtrim(substr(content, 1, 150), ' ') || '… [faded]' as content from memories")(lambda t: t.memories.select("id", T.fade(F.col("content")).alias("content")))
query("tx6_snippets")(lambda t: t.memories.select("id", T.snippet(F.col("content"), T.tokens(F.lit(SEARCH)), 200).alias("snippet")))
query("tx20_explain", "select id, concat_ws(' | ', case when salience > 0 then 'text=' || format('{:.3f}', salience) end, case when confidence > 0 then 'links=' || format('{:.3f}', confidence) end) as why from memories")(lambda t: t.memories.select("id", T.explain({"text": F.col("salience"), "links": F.col("confidence")}).alias("why")))
query("tx21_compress")(lambda t: t.events.groupBy((F.col("event_id") % 50).alias("k")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "user_id", "event_type")))).alias("j")).select("k", T.compressed(F.col("j")).alias("c")).select("k", "c.text", "c.format"))
query("tx19_c4_synthesis", f"""with m as (select id, confidence, content, list_filter(tags, lambda x: starts_with(x, 'topic='))[1][7:] as value from memories where {LIVE}), z as (select value, count(*) as n, avg(confidence) as c from m group by 1 having count(*) >= 3 order by n desc, value limit 5),
  w as (select value, unnest(string_split(regexp_replace(regexp_replace(lower(regexp_replace(content, '[^a-zA-Z0-9_\\s]', '', 'g')), '\\s+', ' ', 'g'), '^ | $', '', 'g'), ' ')) as word from m where value in (select value from z)),
  k as (select value, word, count(*) as n from w where length(word) > 3 and word not in ({_STOP}) group by 1, 2), t as (select value, word, row_number() over (partition by value order by n desc, word) as rn from k)
  select value, n, round(c, 6) as confidence, 'Session ' || value || ': ' || n || ' memories. Topics: ' || (select string_agg(word, ', ' order by rn) from t where t.value = z.value and rn <= 10) as content from z""")(
    lambda t: C.synthesis(t.memories, "topic=").select("value", "n", r6("confidence", "confidence"), "content")
)

# The graph and its upkeep.

query("m8_upsert", "with c as (select src, dst, 0.5::double as w from edges union all select id, id + 1, 0.9::double from memories) select coalesce(e.src, c.src) as src, coalesce(e.dst, c.dst) as dst, coalesce(e.type, 'hebbian') as type, round(coalesce(c.w, e.weight), 6) as weight, case when e.src is null then 1 else e.activation_count + case when c.src is null then 0 else 1 end end as activation_count from edges e full join (select src, dst, max(w) as w from c group by 1, 2) c on e.src = c.src and e.dst = c.dst")(
    lambda t: G.upsert(t.edges, t.edges.select("src", "dst", F.lit(0.5).alias("weight")).unionByName(t.memories.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.9).alias("weight"))).groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("type", F.lit("hebbian")).withColumn("confidence", F.lit(0.8)).withColumn("last_activated", F.lit(None).cast("timestamp_ntz"))).select("src", "dst", "type", r6("weight", "weight"), "activation_count")
)
query("m15_edge_decay", f"with d as (select *, {_EDGE_DAYS} as days from edges), n as (select *, case when days < 0.5 then weight else greatest(weight * power(1 + days / 7, -0.8), 0.001) end as w from d) select src, dst, round(case when abs(weight - w) > 0.001 then w else weight end, 6) as weight from n where days < 0.5 or w >= 0.01")(lambda t: G.decayed(t.edges, now()).select("src", "dst", r6("weight", "weight")))
query("c6_confident_decay", f"with j as (select e.src, e.dst, e.weight, {_EDGE_DAYS} as days, greatest(a.confidence, b.confidence) as c, greatest(a.access_count, b.access_count) as n from edges e join memories a on a.id = e.src join memories b on b.id = e.dst), h as (select *, least(7 * (1 + 2 * greatest(0, (c - 0.5) / 0.5)) * least(2, 1 + 0.5 * ln(1 + n)), 42) as life from j), w as (select *, case when days < 0.5 then weight else greatest(weight * power(1 + days / life, -0.8), 0.001) end as w from h) select src, dst, round(w, 6) as weight from w where w >= 0.01")(
    lambda t: G.decayed_by_confidence(t.edges, t.memories, now()).select("src", "dst", r6("weight", "weight"))
)
query("c7_homeostasis", "with t as (select *, sum(weight) over (partition by src) as total from edges) select src, dst, round(case when total > 10 then weight * 10 / total else weight end, 6) as weight from t where total <= 10 or weight * 10 / total >= 0.01")(lambda t: G.balanced(t.edges).select("src", "dst", r6("weight", "weight")))
query("r18_hebbian_feedback", "with p as (select src, dst, weight, case when (src + dst) % 2 = 0 then 1 else -1 end as s from edges) select src, dst, cast(case when s >= 0 then least(exp(ln(greatest(weight, 0.1)) + ln(1.25)), 5) else greatest(0.001, weight * 0.7) end as float) as weight from p")(
    lambda t: G.strengthened(t.edges, t.edges.select("src", "dst", F.when((F.col("src") + F.col("dst")) % 2 == 0, 1.0).otherwise(-1.0).alias("signal"))).select("src", "dst", F.col("weight").cast("float").alias("weight"))
)
_UND = "u as (select src as id, dst as other, type, weight from edges union all select dst, src, type, weight from edges where src != dst)"
query("m11_inherited_edges", f"with {_UND}, c as (select id as old, id + 1 as new from memories where retracted), x as (select c.new, u.other, u.type, u.weight from u join c on c.old = u.id where u.weight >= 0.4 and u.type not in ('invalidation', 'causal', 'temporal') and u.other in (select id from memories where not retracted) and u.other != c.new) select new as src, other as dst, type, round(weight * 0.7, 6) as weight from x qualify row_number() over (partition by new order by weight desc, other) <= 10")(
    lambda t: G.inherited_edges(t.edges, t.memories, t.memories.where("retracted").select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))).select("src", "dst", "type", r6("weight", "weight"))
)
query("m12_cohesion")(lambda t: G.cohesion(t.edges, t.memories, 7).select("inner", "outer", r6("density", "density"), r6("overlap", "overlap"), r6("cohesion", "cohesion")))
query("m13_penalties", f"with {_UND}, v as (select * from u where type != 'invalidation'), g as (select id from memories where id in (17, 34)), o as (select other as id, max(weight) as w from v where id in (select id from g) and other not in (select id from g) group by 1), s as (select other as id, max(weight) as w from v where id in (select id from o) and other not in (select id from g) and other not in (select id from o) group by 1), l as (select *, 0 as d from o union all select *, 1 from s) select m.id, round(greatest(0.1, confidence - 0.1 * least(w, 1) * power(0.5, d) * 1.5), 6) as confidence from memories m join l using (id)")(
    lambda t: G.confidence_penalties(t.memories, t.edges, t.memories.where("id in (17, 34)").select("id")).select("id", r6("confidence", "confidence"))
)
query("r10_graph_walk", f"""with {_UND}, p as (select id, salience as score, salience as tm from memories where id < 400), sh as (select * from (values ('semantic', 0.4), ('temporal', 0.2), ('causal', 0.25), ('entity', 0.15)) as x(sub, g)),
  n as (select case type when 'connection' then 'semantic' when 'hebbian' then 'semantic' when 'temporal' then 'temporal' when 'causal' then 'causal' when 'bridge' then 'entity' end as sub, u.id, u.other, u.weight, b.tm as ot from u join p a on a.id = u.id join p b on b.id = u.other),
  s0 as (select sub, g, id, score from p cross join sh where tm >= 0.15 qualify row_number() over (partition by sub order by score desc, id) <= greatest(3, ceil(15 * g))),
  h0 as (select s.sub, n.other as id, score * least(weight, 5) / 5 * case when s.sub = 'causal' then 2 else 1 end * 0.3 as gain, g from s0 s join n on n.sub = s.sub and n.id = s.id where ot >= 0.1), b0 as (select *, least(gain * g, 0.15) as boost from h0 where least(gain * g, 0.15) > 0.001),
  s1 as (select sub, g, id, max(gain) as score from b0 group by 1, 2, 3 qualify row_number() over (partition by sub order by max(gain) desc, id) <= greatest(3, ceil(15 * g))),
  h1 as (select s.sub, n.other as id, score * least(weight, 5) / 5 * case when s.sub = 'causal' then 2 else 1 end * 0.09 as gain, g from s1 s join n on n.sub = s.sub and n.id = s.id where ot >= 0.05), b1 as (select *, least(gain * g, 0.15) as boost from h1 where least(gain * g, 0.15) > 0.001),
  x as (select id, boost from b0 union all select id, boost from b1) select id, cast(greatest(0, least(sum(boost), 0.25)) as float) as boost from x group by id""")(
    lambda t: G.graph_walk(t.memories.where("id < 400").select("id", F.col("salience").alias("score"), F.col("salience").alias("text_match"), F.lit(0.0).alias("graph_boost")), t.edges).select("id", F.col("boost").cast("float").alias("boost"))
)
query("r11_spreading")(lambda t: G.spreading_activation(t.memories.where("id < 40").select("id", F.col("salience").alias("score")), t.edges).select("id", r6("activation", "activation")))


def _scored(t: Tables) -> DataFrame:
    """The best 60 by BM25 with every part of their score."""
    hits = R.pinned(Q.bm25(t.memories, SEARCH, 60).select("id", "score", F.lit(None).cast("double").alias("similarity")), 60)
    ids = [r["id"] for r in hits.collect()]
    return R.scored(hits, t.memories.where(F.col("id").isin(ids)), t.edges_at(ids), SEARCH, now())


query("r8_bridge")(lambda t: R.bridged(_scored(t)).select("id", r6("composite", "composite"), r6("graph_boost", "graph_boost")))
query("c8_fade", f"with f as (select id, agent, content, round({_IDLE}, 6) as idle from memories where {LIVE} and access_count between 1 and 9 and length(content) >= 250 and {_IDLE} >= 45 and memory_class not in ('canonical', 'structural')) select id, agent, rtrim(substr(content, 1, 150), ' ') || '… [faded]' as content from f qualify row_number() over (partition by agent order by idle desc, id) <= 25")(lambda t: C.faded(t.memories, now()))
query("c9_forget", f"with d as (select src as id, count(*) as degree from edges group by 1), o as (select m.*, coalesce(degree, 0) as degree from memories m left join d using (id) where {LIVE}), b as (select list_sort(list(degree))[least(cast(floor(0.25 * count(*)) as bigint), count(*) - 1) + 1] as bar from o) select id, agent, degree from o, b where {_AGE} > 7 and {_IDLE} > least(30 * (1 + 0.6 * ln(1 + access_count)) * (1 + 3 * greatest(0, (confidence - 0.5) / 0.5)), 360) and degree <= bar")(
    lambda t: C.forgotten(t.memories, t.edges, now())
)
query("c10_delete", f"select id, agent from memories where stage = 'archived' and access_count = 0 and {_AGE} > 10 and id not in (select src from edges) and id not in (select dst from edges)")(lambda t: C.deleted(t.memories, t.edges, now(), C.ConsolidationConfig(delete_days=10)))
query("c12_drift", f"with {_ENDS}, c as (select id, confidence, least(0.03, greatest(-0.03, case when id % 4 = 0 then 0.01 else 0 end - case when id in (select id from ends) then 0 else 0.02 end - case when {_IDLE} > 30 and confidence > 0.3 then 0.01 else 0 end)) as step from memories where {LIVE}) select id, round(case when step = 0 then confidence else greatest(0.15, least(0.85, confidence + step)) end, 6) as confidence from c")(
    lambda t: C.drifted(t.memories, t.edges, t.memories.where("id % 4 = 0").select("id"), now()).select("id", r6("confidence", "confidence"))
)
query("c2_clusters")(lambda t: C.clusters(t.memories, t.agent_vectors, C.ConsolidationConfig(cluster_similarity=0.35, complete_link=0.2)))
query("c3_cluster_edges")(lambda t: C.cluster_edges(C.clusters(t.memories, t.agent_vectors, C.ConsolidationConfig(cluster_similarity=0.35, complete_link=0.2)), t.memories, t.edges).select("src", "dst", r6("weight", "weight"), "change"))
query("c5_j17_bridges", _PAIRS + ", c as (select id, agent, id % 9 as cluster from memories), x as (select p.*, ca.cluster as x1, cb.cluster as x2 from p join c ca on ca.id = p.a join c cb on cb.id = p.b where s >= 0.15 and ca.cluster != cb.cluster), y as (select agent, a, b, s from x qualify row_number() over (partition by agent, least(x1, x2), greatest(x1, x2) order by s desc, a, b) = 1), z as (select * from y order by s desc, a, b limit 20), w as (select a as src, b as dst, s from z union all select b, a, s from z) select src, dst, round(s, 5) as similarity from w where not exists (select 1 from edges e where e.src = w.src and e.dst = w.dst)")(
    lambda t: C.bridges(t.memories.select("agent", (F.col("id") % 9).alias("cluster"), "id"), t.agent_vectors, t.edges).select("src", "dst", F.round(F.round("similarity", 6), 5).alias("similarity"))
)
query("c11_redundant")(lambda t: C.redundant(t.memories, t.agent_vectors, C.ConsolidationConfig(redundancy_similarity=0.35)))

# The write path.

_WRITES = "case event_type when 'error' then 'friction' when 'signup' then 'decision' when 'purchase' then 'surprise' else 'observation' end"


def _writes(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr(_WRITES).alias("event_type"), F.lit("what was seen").alias("content"), ((F.col("event_id") % 10) / 10).alias("surprise"), (F.col("event_id") % 4 == 0).alias("decision_made"), ((F.col("event_id") % 7) / 10).alias("causal_depth"), ((F.col("event_id") % 3) / 5).alias("resolution_effort"), ((F.col("event_id") % 11) / 10).alias("novelty"), F.when(F.col("event_id") % 13 == 0, "canonical").when(F.col("event_id") % 17 == 0, "ephemeral").alias("memory_class"))


query("m1_salience", f"""with w as (select event_id, {_WRITES} as k, (event_id % 10) / 10 as s, event_id % 4 = 0 as d, (event_id % 7) / 10 as c, (event_id % 3) / 5 as e, (event_id % 11) / 10 as n, case when event_id % 13 = 0 then 'canonical' when event_id % 17 = 0 then 'ephemeral' else 'working' end as m from events),
  b as (select *, case k when 'decision' then 0.15 when 'friction' then 0.2 when 'surprise' then 0.25 else 0 end as bonus, not (k = 'surprise' or (k = 'decision' and d)) and s + c + e + case when d then 0.5 else 0 end < 0.5 as weak from w),
  r as (select *, least(0.15 * s + case when d then 0.15 else 0 end + 0.15 * c + 0.1 * e + case when weak and bonus > 0 then least(0.45 * n, 0.3) else 0.45 * n end + case when weak and bonus > 0 then bonus * 0.25 else bonus end, 1) as raw from b),
  f as (select *, case when m = 'canonical' then greatest(raw, 0.7) else raw end as score from r)
  select event_id, round(score, 6) as score, case when m = 'canonical' or round(score, 9) >= 0.4 then 'active' when round(score, 9) >= 0.2 then 'staging' else 'discard' end as disposition from f""")(
    lambda t: M.scored_writes(_writes(t)).select("event_id", r6("score", "score"), F.when(F.col("memory_class").eqNullSafe("canonical") | (F.round("score", 9) >= 0.4), "active").when(F.round("score", 9) >= 0.2, "staging").otherwise("discard").alias("disposition"))
)
query("m2_text_novelty")(lambda t: M.best_text_match(t.memories.where("stage = 'staging'").select(F.col("id").alias("write_id"), "agent", "concept", "content"), t.memories.where("stage = 'active'")).select("write_id", "id", r6("score", "score"), "same_concept"))
query("m2_vector_novelty", _PAIRS + ", q as (select a as write_id, b as id, s from p union all select b, a, s from p) select write_id, id, round(s, 5) as score from q where write_id % 10 = 6 qualify row_number() over (partition by write_id order by s desc, id) = 1")(
    lambda t: M.best_vector_match(t.agent_vectors.where("id % 10 = 6").select(F.col("id").alias("write_id"), "agent", "vector"), t.agent_vectors).select("write_id", "id", F.round(F.round("score", 6), 5).alias("score"))
)
query("m3_write_fold")(lambda t: M.folded_writes(t.memories, t.memories.select((F.col("id") + 1_000_000).alias("write_id"), "agent", "concept", F.substring("content", 61, 80).alias("content"), F.lit(0.6).alias("confidence"))))
query("m4_reinforce", "select id, round(least(0.85, least(0.95, confidence + 0.05) + 0.02 / (1 + sqrt(access_count))), 6) as confidence, access_count + 1 as access_count from memories")(lambda t: M.reinforced(t.memories, t.memories.select("id", F.lit("more").alias("content"))).select("id", r6("confidence", "confidence"), "access_count"))
query("m5_prior_confidence", f"select event_id, case when event_id % 5 = 0 then 0.25 when event_id % 5 = 1 then 0.4 else case {_WRITES} when 'decision' then 0.65 when 'friction' then 0.6 when 'surprise' then 0.55 else 0.45 end end::double as confidence from events")(
    lambda t: t.events.select("event_id", S.prior_confidence(F.when(F.col("event_id") % 5 == 0, "discard").when(F.col("event_id") % 5 == 1, "staging").otherwise("active"), F.expr(_WRITES)).alias("confidence"))
)
query("m6_m7_supersede", "select id, round(case when superseded_by is not null then greatest(0.2, confidence * 0.4) else confidence end, 6) as confidence, stage from memories")(lambda t: M.superseded(t.memories, t.memories.where("superseded_by is not null").select(F.col("id").alias("old"), F.col("superseded_by").alias("new")), "by_tool")[0].select("id", r6("confidence", "confidence"), "stage"))
query("m6_batch_supersede", "select id, round(case when superseded_by is not null then 0.1 else confidence end, 6) as confidence, case when superseded_by is not null then 'archived' else stage end as stage from memories")(lambda t: M.superseded(t.memories, t.memories.where("superseded_by is not null").select(F.col("id").alias("old"), F.col("superseded_by").alias("new")), "batch")[0].select("id", r6("confidence", "confidence"), "stage"))
query("m10_entity_edges")(lambda t: M.entity_edges(t.memories).select("src", "dst", r6("weight", "weight"), "k"))
query("m16_sweep", f"with x as (select id, agent, created_at from memories where stage = 'staging' and ttl_ms > 0 and created_at + to_milliseconds(ttl_ms) < {_NOW}) select id, agent, case when id % 3 = 0 then 'promoted' when {_AGE} > 1 then 'discarded' else 'kept' end as action from x")(
    lambda t: M.swept_staging(M.expired_staging(t.memories, now()), t.memories.where("id % 3 = 0").select("id", F.lit(0.7).alias("score")), now()).select("id", "agent", "action")
)
query("a5_staging_outcomes", f"select count(*) filter (id % 3 = 0) as promoted, count(*) filter (id % 3 != 0 and {_AGE} > 1) as discarded, 0::bigint as expired from memories where stage = 'staging' and ttl_ms > 0 and created_at + to_milliseconds(ttl_ms) < {_NOW}")(
    lambda t: A.staging_outcomes(M.swept_staging(M.expired_staging(t.memories, now()), t.memories.where("id % 3 = 0").select("id", F.lit(0.7).alias("score")), now()))
)


def _swept(t: Tables) -> DataFrame:
    """Expired staging memories with what their best match among the active ones makes of them."""
    expired = M.expired_staging(t.memories, now())
    best = M.best_text_match(expired.select(F.col("id").alias("write_id"), "agent", "concept", "content"), t.memories.where("stage = 'active'"))
    return M.swept_staging(expired, best.select(F.col("write_id").alias("id"), "score"), now())


query("m16_sweep_all")(lambda t: _swept(t).select("id", "agent", r6("score", "score"), "action"))
query("a5_staging_outcomes_all")(lambda t: A.staging_outcomes(_swept(t)))
query("m9_discovered_links", _PAIRS + ", q as (select a as src, b as dst, s from p where s >= 0.35 union all select b, a, s from p where s >= 0.35), t as (select src, dst, s from q qualify row_number() over (partition by src order by s desc, dst) <= 5), u as (select src, dst, s from t union select dst, src, s from t) select src, dst, round(s, 5) as weight from u")(
    lambda t: M.discovered_links(t.agent_vectors, 0.35).select("src", "dst", F.round("weight", 5).alias("weight"))
)

# Coordination.

query("k13_context_memories", "select event_id as id, 'context of ' || event_id as concept, json_extract(props, '$.k')::int as k from events where json_valid(props)")(
    lambda t: M.context_memories(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("agent"), F.col("props").alias("context"))).select("id", "concept", F.get_json_object("content", "$.k").cast("int").alias("k"))
)
query("k1_latest_agents", "select user_id as agent, max_by(event_type, epoch_us(ts)::hugeint * 1000000 + event_id) as event_type, count(*) as n_updates from events group by 1")(lambda t: K.latest_state(t.events.withColumnRenamed("user_id", "agent"), "agent", "event_type").select("agent", "event_type", "n_updates"))
query("k2_transitions", "with h as (select event_id, user_id as id, ts, case event_type when 'signup' then 'pending' when 'view' then 'assigned' when 'click' then 'in_progress' when 'purchase' then 'completed' else 'failed' end as status from events), l as (select *, lag(status) over (partition by id order by ts, event_id) as b from h) select event_id, b as before, status from l where b is not null and not coalesce(case b when 'pending' then status in ('assigned', 'cancelled') when 'assigned' then status in ('in_progress', 'completed', 'failed', 'blocked') when 'in_progress' then status in ('completed', 'failed', 'blocked') end, false)")(
    lambda t: K.invalid_transitions(t.events.select("event_id", F.col("user_id").alias("id"), "ts", F.expr("case event_type when 'signup' then 'pending' when 'view' then 'assigned' when 'click' then 'in_progress' when 'purchase' then 'completed' else 'failed' end").alias("status"))).select("event_id", "before", "status")
)
query("k3_stale", "with a as (select user_id as id, max(ts) as last_seen from events group by 1) select a.id, round((epoch_us(timestamp '2024-01-30') - epoch_us(last_seen)) / 1e6, 3) as idle_seconds from a join agents g on g.id = a.id where g.status != 'dead' and epoch_us(timestamp '2024-01-30') - epoch_us(last_seen) > 600000000")(
    lambda t: K.stale(t.agents.join(t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_seen")), "id"), F.lit("2024-01-30").cast("timestamp"), 600).select("id", F.round("idle_seconds", 3).alias("idle_seconds"))
)
query("k4_retry", "select event_id, case when event_id % 5 < 3 then 'pending' else 'failed' end as status, event_id % 5 + case when event_id % 5 < 3 then 1 else 0 end as attempts from events where event_type = 'error'")(
    lambda t: K.retry_or_fail(t.events.where("event_type = 'error'").select("event_id", (F.col("event_id") % 5).alias("attempts"), F.lit("it timed out").alias("result"))).select("event_id", "status", "attempts")
)
query("k5_locks", "with f as (select event_type as path, min_by(user_id, epoch_us(ts)::hugeint * 1000000 + event_id) as holder from events group by 1) select event_id, holder, user_id = holder as granted from events join f on path = event_type")(lambda t: K.lock_holders(t.events.select("event_id", F.col("event_type").alias("path"), F.col("user_id").alias("agent"), "ts")).select("event_id", "holder", "granted"))
query("k8_mailbox", "select user_id as receiver, event_id as id from events where event_type != 'view' qualify row_number() over (partition by user_id order by ts, event_id) <= 10")(lambda t: K.mailbox(t.events.select(F.col("user_id").alias("receiver"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "view").alias("delivered"))).select("receiver", "id"))
query("k9_feed", "select event_id, event_type from events where event_id > 500 order by event_id limit 50")(lambda t: K.feed(t.events, 500).select("event_id", "event_type"))
query("k11_deep_health", "select count(*) as n, case when count(*) > 2 then 'degraded' else 'ok' end as status from agents where status = 'dead'")(lambda t: K.deep_health(t.agents.where("status = 'dead'").agg(F.count("*").alias("n"))))
query("k12_delivery_rate", "select user_id as agent, sum((event_type != 'error')::int)::bigint as delivered, count(*) as attempts, round(sum((event_type != 'error')::int) / count(*), 6) as delivery_rate from events group by 1")(
    lambda t: K.delivery_rate(t.events.select(F.col("user_id").alias("agent"), (F.col("event_type") != "error").cast("long").alias("delivered"), F.lit(1).cast("long").alias("attempts"))).select("agent", "delivered", "attempts", r6("delivery_rate", "delivery_rate"))
)

_MOVES = "(select o_orderkey as id, case when o_orderkey % 10 = 0 then o_custkey + 1 end as target from orders where o_orderkey % 5 = 0)"
query("k10_reassigned", f"select t.id, case when m.id is null or status = 'completed' then agent else target end as agent, case when m.id is null or status = 'completed' then status when target is not null then 'assigned' else 'pending' end as status from tasks t left join {_MOVES} m on m.id = t.id")(
    lambda t: K.reassigned(t.tasks, t.tasks.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("agent") + 1).alias("target")))
)
query("k10_claimed", "with c as (select event_id % 15000 as id, min_by(user_id, epoch_us(ts)::hugeint * 1000000 + event_id) as first from events group by 1) select t.id, case when status = 'pending' and c.id is not null then first else agent end as agent, case when status = 'pending' and c.id is not null then 'assigned' else status end as status from tasks t left join c on c.id = t.id")(
    lambda t: K.claimed(t.tasks, t.events.select((F.col("event_id") % 15000).alias("id"), F.col("user_id").alias("agent"), "ts", "event_id"))
)
query("k10_killed", "select t.id, case when t.status = 'in_progress' and a.id is not null then 'failed' else t.status end as status from tasks t left join agents a on a.id = t.agent and a.status = 'working'")(
    lambda t: K.killed(t.agents, t.tasks, t.agents.where("status in ('working', 'dead')").select("id"))[1].select("id", "status")
)
query("k4_st10_heartbeats", "select event_id from events where not (event_type = 'view' and ts < timestamp '2024-01-20' - interval 1 hour)")(
    lambda t: K.without_old_heartbeats(t.events.withColumn("event_type", F.when(F.col("event_type") == "view", "heartbeat").otherwise(F.col("event_type"))), F.lit("2024-01-20").cast("timestamp")).select("event_id")
)
query("k4_st10_dead_agents", "with a as (select user_id as id, max(ts) as last_seen from events group by 1) select g.id from agents g left join a on a.id = g.id where not (status = 'dead' and coalesce(last_seen < timestamp '2024-01-25' - interval 24 hour, false))")(
    lambda t: K.without_dead(t.agents.join(t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_seen")), "id", "left"), F.lit("2024-01-25").cast("timestamp")).select("id")
)
query("s8_insert", f"select id, agent, confidence, salience, stage, memory_class, memory_type, access_count, retracted, tags from memories union all select o_orderkey + 1000000, 'orders', case when o_orderkey % 2 = 0 then 0.9 else 0.5 end, 0.5, 'active', 'working', 'unclassified', 0, false, [] from orders")(
    lambda t: M.inserted(t.memories, t.orders.select((F.col("o_orderkey") + 1_000_000).alias("id"), F.lit("orders").alias("agent"), F.lit("order").alias("concept"), F.col("o_orderstatus").alias("content"), F.when(F.col("o_orderkey") % 2 == 0, 0.9).alias("confidence")), now()).select("id", "agent", "confidence", "salience", "stage", "memory_class", "memory_type", "access_count", "retracted", "tags")
)
query("m14_staging_budget", f"select id, agent from memories where stage = 'staging' and ttl_ms > 0 and created_at + to_milliseconds(ttl_ms) < {_NOW} and (select max(n) from (select count(*) as n from memories where stage = 'staging' and not retracted group by agent)) > 20")(lambda t: M.over_staging_budget(t.memories, now(), 20))
query("p7_memory_type", "select id from memories where not retracted and stage in ('active', 'fading') and memory_type = 'semantic'")(lambda t: R.in_scope(t.memories, RecallConfig(memory_type="semantic", include_stages=("active", "fading"))).select("id"))

# Retrieval quality over the labelled vectors: each of the first 50 is a query, its label's others are relevant.


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(query, id, rank) of the nearest vectors, and (query, id) of the relevant ones."""
    q = t.embeddings.where("vec_id < 50").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))  # a stated set of 50 queries
    both = t.embeddings.join(F.broadcast(q)).where("vec_id != query")
    sims = both.select("query", F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.col("qv")), 5).alias("s"), (F.col("label") == F.col("ql")).alias("rel"))
    ranked = sims.withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("s"), "id")))
    return ranked.where("rank <= 20").select("query", "id", "rank"), sims.where("rel").select("query", "id")


_RANKED = "with s as (select q.vec_id as query, d.vec_id as id, round(list_dot_product(cast(q.embedding as double[]), cast(d.embedding as double[])), 5) as s, q.label = d.label as rel from embeddings q join embeddings d on q.vec_id < 50 and q.vec_id != d.vec_id), r as (select *, row_number() over (partition by query order by s desc, id) as rank from s), k as (select * from r where rank <= 20), t as (select query, id from s where rel)"
query("e1_recall_at", _RANKED + " select t.query, round(count(k.id) / count(*), 6) as recall from t left join k on k.query = t.query and k.id = t.id and rank <= 10 group by 1")(lambda t: A.recall_at(*_ranked(t), 10).select("query", r6("recall", "recall")))
query("e2_mrr", _RANKED + ", f as (select query, min(rank) as rank from k where rel group by 1) select round(avg(coalesce(1 / rank, 0)), 6) as mrr from (select distinct query from t) left join f using (query)")(lambda t: A.mean_reciprocal_rank(*_ranked(t)).select(r6("mrr", "mrr")))
query("e3_ndcg", _RANKED + ", g as (select query, sum(1 / log2(rank + 1)) as dcg from k where rel and rank <= 10 group by 1), i as (select query, least(count(*), 10) as n from t group by 1) select query, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda x: 1 / log2(x + 1))), 6) as ndcg from i left join g using (query)")(lambda t: A.ndcg_at(*_ranked(t), 10).select("query", r6("ndcg", "ndcg")))
query("e5_dedup_quality", "with p as (select a.o_orderkey as a, b.o_orderkey as b, a.o_orderdate = b.o_orderdate as same_day, a.o_orderpriority = b.o_orderpriority as same_prio from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey), n as (select count(*) filter (same_prio) as f, count(*) filter (same_prio and a % 2 = 0) as tp, count(*) filter (a % 2 = 0) as t from p) select round(tp / f, 6) as precision, round(tp / t, 6) as recall, round(2 * (tp / f) * (tp / t) / (tp / f + tp / t), 6) as f1 from n")(
    lambda t: _dedup(t)
)


def _dedup(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    p = o.select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("o_orderpriority").alias("pa")).join(o.select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("o_orderpriority").alias("pb")), "o_custkey").where("a < b")
    out = A.dedup_quality(p.where("pa = pb").select("a", "b"), p.where("a % 2 = 0").select("a", "b"))
    return out.select(r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


query("e6_mean", "select event_type, round(coalesce(avg(value), 0), 6) as mean from events group by 1")(lambda t: t.events.groupBy("event_type").agg(r6(F.coalesce(F.avg("value"), F.lit(0.0)), "mean")))

# Retrieval end to end.


def _recall(t: Tables, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    out = R.recall(t.memories, t.edges_at, t.vectors, SEARCH, now(), t.query_vector(), cfg)
    return out.select("id", "agent", "concept", r6("final", "final"), r6("text_match", "text_match"), r6("graph_boost", "graph_boost"), "why")


_NAMED = "Did With or Les tell what Eaux and Der meant"  # Did is no name
_ASKED = "['with', 'les', 'eaux', 'der']"
query("r9_entity_bridge", f"""with m as (select id, salience as tm, list_transform(list_append(tags, 'Entity:' || concept), lambda t: regexp_replace(lower(t), '^entity:', '')) as v from memories),
  h as (select id, tm, len(list_filter(v, lambda x: list_contains({_ASKED}, x) or list_has_any(string_split_regex(x, '\\s+'), {_ASKED}))) as k from m)
  select id, round(least(0.4, k * 0.4 * tm), 6) as boost from h where tm >= 0.1 and k > 0""")(
    lambda t: R.entity_bridged(t.memories.withColumn("text_match", F.col("salience")).withColumn("tags", F.concat("tags", F.array(F.concat(F.lit("Entity:"), "concept")))), _NAMED).select("id", r6("boost", "boost"))
)
query("recall_hybrid")(_recall)
query("recall_targeted")(lambda t: _recall(t, RecallConfig(mode="targeted", limit=5)))
query("r14_recall_gated")(lambda t: _recall(t, RecallConfig(weak_pool_penalty=True)))
query("tx5_rocchio_terms", None)(lambda t: t.spark.createDataFrame([(i, w) for i, w in enumerate(R.feedback_terms(_scored(t), SEARCH))], "i int, term string"))
query("r17_side_effects")(lambda t: R.side_effects(_recall(t), t.memories).select("id", r6("confidence", "confidence"), "access_count"))


# Stemmed full text over a fresh index of all memories.


def _stemmed(t: Tables) -> str:
    path = _fresh(t, "stems")
    ST.store_stemmed(t.memories, path)
    return path


query("tx2_stemmed_any")(lambda t: ST.stemmed_search(t.spark, _stemmed(t), "the tions and those ing or pour").select("id", r6("rank", "rank")))
query("tx2_stemmed_all")(lambda t: ST.stemmed_search(t.spark, _stemmed(t), "tion ing", every=True).select("id", r6("rank", "rank")))

# Many recalls at once: every hundredth memory is asked for what it recalls among all.
query("recall_many")(lambda t: RM.recall_many(t.memories, t.edges, t.vectors, RM.asked_of(t.memories.where("id % 100 = 0")).join(t.vectors.withColumnRenamed("id", "query"), "query", "left"), now()).select("query", "id", "agent", r6("final", "final"), r6("text_match", "text_match"), r6("graph_boost", "graph_boost"), r6("recall_confidence", "confidence")))
query("m9_recalled_links")(lambda t: RM.discovered_links(t.memories, t.edges, t.vectors, t.memories.where("id % 100 = 0"), now(), 0.4).select("src", "dst", r6("weight", "weight")))
query("m16_recalled_sweep")(lambda t: RM.swept_staging(t.memories, t.edges, t.vectors, M.expired_staging(t.memories, now()), now()).select("id", "agent", r6("score", "score"), "action"))


# Recall with a model's scores, and on an index; both are built for the run.


def _scorer(t: Tables) -> MO.Slot:
    return MO.trained_scorer(MO.labelled_pairs(t.memories))


def _recall_indexed(t: Tables) -> DataFrame:
    path = _fresh(t, "index")
    R.stored_index(t.memories, path)
    out = R.recall(t.memories, t.edges_at, t.vectors, SEARCH, now(), t.query_vector(), index=path)
    return out.select("id", "agent", "concept", r6("final", "final"), r6("text_match", "text_match"), r6("graph_boost", "graph_boost"), "why")


query("recall_indexed")(_recall_indexed)
query("recall_reranked")(lambda t: R.recall(t.memories, t.edges_at, t.vectors, SEARCH, now(), t.query_vector(), scorer=_scorer(t)).select("id", r6("final", "final"), r6("composite", "composite"), r6("recall_confidence", "confidence")))


# Vectors of a model for all active memories, in a fresh store; the second run finds nothing to do.


def _backfilled(t: Tables) -> DataFrame:
    active, store = t.memories.where("stage = 'active'"), MO.EncodedStore(t.spark, _fresh(t, "vectors"), MO.hashed_encoder())
    store.backfill(active)
    again = store.backfill(active)
    own = store.vectors(active).join(store.texts(active).select("id", "digest"), "id")
    return own.select("id", "digest", F.size("vector").alias("n"), F.round(V.dot(F.col("vector"), F.col("vector")), 4).alias("length"), F.lit(again).cast("long").alias("again"))


query("c1_backfill", "select id, sha256(concat_ws(' ', concept, content)) as digest, 64 as n, cast(1 as double) as length, cast(0 as bigint) as again from memories where stage = 'active' and concat_ws(' ', concept, content) != ''")(_backfilled)

# Terms that stand near each other, and queries widened by them.
_NEAR_TERMS = f"""with w as (select {_W.format(c='content')} as w from memories), q as (select w, unnest(range(1, len(w) + 1)) as i from w),
  r as (select w[i] as a, unnest(w[i + 1:i + 4]) as b from q), e as (select a, b from r where a != b union all select b, a from r where a != b),
  n as (select a, b, count(*) as n from e group by 1, 2), m as (select a, sum(n) as na from n group by 1), z as (select sum(n) as total from n),
  s as (select n.a as term, n.b as other, n.n, round(ln(n.n::double * total / (m.na::double * k.na)), 6) as ppmi from n join m on m.a = n.a join m k on k.a = n.b cross join z where n.n >= 3),
  t as (select * from s where ppmi > 0 qualify row_number() over (partition by term order by ppmi desc, n desc, other) <= 5)"""
query("tx22_associations", _NEAR_TERMS + " select term, other, cast(n as bigint) as n, ppmi from t")(lambda t: E.associations(t.memories).select("term", "other", "n", "ppmi"))
query("tx22_expanded", _NEAR_TERMS + f""", asked as (select id, array_to_string(string_split(content, ' ')[1:1 + id % 6], ' ') as text from memories where id % 100 = 0), q2 as (select id, text, lower(trim(text)) as norm, {_W.format(c='text')} as terms from asked),
  sk as (select *, len(norm) = 0 or len(norm) > 50 or len(list_distinct(list_filter(string_split_regex(norm, '\\s+'), lambda x: len(x) > 2))) >= 5 as skip from q2),
  ex as (select id, other, round(sum(ppmi), 6) as s from (select id, terms, unnest(list_distinct(terms)) as term from sk where not skip) join t using (term) where not list_contains(terms, other) group by 1, 2),
  b as (select id, string_agg(other, ' ' order by s desc, other) as more from (select * from ex qualify row_number() over (partition by id order by s desc, other) <= 5) group by 1)
  select sk.id, case when more is null then text else text || ' ' || more end as expanded from sk left join b using (id) where text is not null""")(
    lambda t: E.expanded(t.memories.where("id % 100 = 0").select("id", F.array_join(F.slice(F.split("content", " "), 1, (1 + F.col("id") % 6).cast("int")), " ").alias("text")), E.associations(t.memories)).select("id", "expanded")
)

# Streams over the whole table of events, run until they have seen it; rows that the watermark has not passed wait.


def _streamed(t: Tables, f: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/event[s].parquet")  # as a pattern it may be a file or a folder
    own = events.select("event_id", F.col("user_id").alias("agent"), F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("event_id") % 97).alias("memory_id"), (F.col("event_type") == "purchase").alias("useful"))
    out, df = _fresh(t, "stream"), f(own)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


def _activations(events: DataFrame) -> DataFrame:
    """Activations; other events only move the watermark, under many keys of their own and without a memory."""
    own = F.col("event_type").isin("view", "click")
    aside = -1 - F.pmod(F.xxhash64("event_id"), F.lit(4096))  # under one key they would be one state, three rows of five
    return events.withColumn("agent", F.when(own, F.col("agent")).otherwise(aside)).withColumn("memory_id", F.when(own, F.col("memory_id")))


_PASSED = "p as (select epoch_us(max(ts)) // 1000 * 1000 as passed from events), e as (select *, epoch_us(ts) as us from events where epoch_us(ts) <= (select passed from p))"
_NOW_LATE = "0 seconds"
query("st1_recent_pairs", f"with {_PASSED}, a as (select event_id, user_id, us, event_id % 97 as m, row_number() over (partition by user_id order by us, event_id) as rn from e where event_type in ('view', 'click')) select y.event_id, x.event_id as with_event from a x join a y on x.user_id = y.user_id and x.rn < y.rn and y.rn - x.rn < 50 and x.m != y.m and y.us - x.us <= 86400000000")(
    lambda t: _streamed(t, lambda e: SS.recent_pairs(_activations(e), 86400, 50, _NOW_LATE)).select("event_id", "with_event")
)
query("st2_confirmed_feedback", "select f.event_id as feedback_id, a.event_id as activation_id from feedback f join activations a on a.memory_id = f.memory_id and a.ts <= f.ts and a.ts >= f.ts - interval 1 day")(
    lambda t: _streamed(t, lambda e: SO.confirmed_feedback(e.where("event_type in ('purchase', 'error')"), e.where("event_type in ('view', 'click')"), 86400)).select("feedback_id", "activation_id")
)
query("st4_rate_limit", f"with {_PASSED} select event_id, count(*) over (partition by user_id order by us range between 86400000000 preceding and current row) as in_window, count(*) over (partition by user_id order by us range between 86400000000 preceding and current row) > 5 as limited from e")(
    lambda t: _streamed(t, lambda e: SS.rate_limited(e, 86400, 5, _NOW_LATE)).select("event_id", "in_window", "limited")
)
query("st6_counters", "select user_id as agent, count(*) filter (event_type in ('view', 'click')) as recalls, count(*) filter (event_type = 'purchase') as writes, epoch_us(max(ts)) as last_us from events group by 1")(
    lambda t: _streamed(t, SO.checkpoint_counters, "complete").select("agent", "recalls", "writes", F.unix_micros("last_ts").alias("last_us"))
)
query("st8_quiescent", f"with {_PASSED}, n as (select event_id, us, lead(us) over (partition by user_id order by us, event_id) as following from e) select event_id, us as last_us from n, p where coalesce(following, passed) - us >= 43200000000")(
    lambda t: _streamed(t, lambda e: SS.quiescent(e, 720, _NOW_LATE)).select("event_id", F.unix_micros("last_ts").alias("last_us"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["recall_hybrid"](spark, sf_dir)
