"""The coordination plane: queue, state machine, locks, liveness, feeds, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses an assignment may move to.
TRANSITIONS = {"pending": ("assigned", "cancelled"), "assigned": ("in_progress", "completed", "failed", "blocked"), "in_progress": ("completed", "failed", "blocked"), "blocked": ("in_progress", "assigned", "failed")}


def ranked_by(column: str, order: tuple[str, ...]) -> Column:
    """A sort key by position in a list; what is not listed comes last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def in_workspace(column: str, workspace: str) -> Column:
    return (F.col(column) == workspace) | F.col(column).isNull()


def blocked(tasks: DataFrame) -> DataFrame:
    """Tasks with ``is_blocked``: what blocks them is not completed."""
    done = tasks.where("status = 'completed'").select(F.col("id").alias("blocked_by"), F.lit(True).alias("__done"))
    return tasks.join(done, "blocked_by", "left").withColumn("is_blocked", F.col("blocked_by").isNotNull() & F.col("__done").isNull()).drop("__done")


def unblocked(tasks: DataFrame) -> DataFrame:
    """Tasks whose blocker is completed."""
    return tasks.where("blocked_by is not null").join(tasks.where("status = 'completed'").select(F.col("id").alias("blocked_by")), "blocked_by", "left_semi")


def next_for_agents(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, id, priority): the task that each agent is given when it asks: pending, not blocked,
    first one reserved for it, else an unassigned one of its workspace or of none; the
    highest priority, then the oldest.  Of unassigned tasks only the best of each workspace move."""
    free = blocked(tasks).where("status = 'pending' and not is_blocked")
    order = lambda step: F.struct(F.lit(step).alias("step"), (-F.col("priority")).alias("p"), "created_at", "id")
    reserved = free.where("agent is not null").join(agents.select(F.col("id").alias("agent")), "agent", "left_semi").select("agent", order(1).alias("o"))
    best = free.where("agent is null").groupBy("workspace").agg(F.min(order(2)).alias("o"))
    own = best.where("workspace is not null").join(agents.select(F.col("id").alias("agent"), "workspace"), "workspace").select("agent", "o")
    anyone = agents.select(F.col("id").alias("agent")).join(F.broadcast(best.where("workspace is null").select("o")))  # at most one row
    found = reserved.unionByName(own).unionByName(anyone).groupBy("agent").agg(F.min("o").alias("o"))
    return found.select("agent", "o.id", (-F.col("o.p")).alias("priority"))


def claimed(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, agent, status) after claims (id, agent, ts, event_id): a pending task goes to the first."""
    first = claims.groupBy("id").agg(F.min_by("agent", F.struct("ts", "event_id")).alias("__agent"))
    won = (F.col("status") == "pending") & F.col("__agent").isNotNull()
    return tasks.join(first, "id", "left").select("id", F.when(won, F.col("__agent")).otherwise(F.col("agent")).alias("agent"), F.when(won, "assigned").otherwise(F.col("status")).alias("status"))


def reassigned(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, agent, status) after one move each (id, target): assigned to the target, or pending again
    without one; completed and failed tasks stay as they are."""
    own = tasks.join(moves.select("id", F.col("target").alias("__target"), F.lit(True).alias("__moved")), "id", "left")
    moved = F.coalesce("__moved", F.lit(False)) & ~F.col("status").isin("completed", "failed")
    status = F.when(F.col("__target").isNotNull(), "assigned").otherwise("pending")
    return own.select("id", F.when(moved, F.col("__target")).otherwise(F.col("agent")).alias("agent"), F.when(moved, status).otherwise(F.col("status")).alias("status"))


def killed(agents: DataFrame, tasks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agents, tasks) after the named agents (id) are killed: dead, their running tasks failed.
    Agents that are dead already change nothing."""
    gone = agents.where("status != 'dead'").join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("__gone"))
    a = agents.join(gone, "id", "left").withColumn("status", F.when(F.col("__gone"), "dead").otherwise(F.col("status"))).drop("__gone")
    t = tasks.join(gone.withColumnRenamed("id", "agent"), "agent", "left")
    running = F.col("__gone") & F.col("status").isin("assigned", "in_progress")
    return a, t.withColumn("status", F.when(running, "failed").otherwise(F.col("status"))).drop("__gone")


def without_old_heartbeats(events: DataFrame, as_of: Column, seconds: int = 3600, kind: str = "event_type") -> DataFrame:
    """Events without heartbeats of more than an hour ago; all others stay for good."""
    old = (F.col(kind) == "heartbeat") & (F.unix_micros(F.col("ts").cast("timestamp")) < F.unix_micros(as_of) - seconds * 1_000_000)
    return events.where(~F.coalesce(old, F.lit(False)))


def without_dead(agents: DataFrame, as_of: Column, hours: int = 24, seen: str = "last_seen") -> DataFrame:
    """Agents without those that are dead and were last seen more than a day ago."""
    old = (F.col("status") == "dead") & (F.unix_micros(F.col(seen).cast("timestamp")) < F.unix_micros(as_of) - hours * 3_600_000_000)
    return agents.where(~F.coalesce(old, F.lit(False)))


def invalid_transitions(history: DataFrame) -> DataFrame:
    """Rows of (id, ts, status) whose status may not follow the one before."""
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    rows = history.withColumn("before", F.lag("status").over(w)).where("before is not null")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return rows.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("before")), F.col("status")), F.lit(False)))


def latest_state(events: DataFrame, key: str, *columns: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The last row of each key: an upsert log folded to its current state."""
    last = events.groupBy(key).agg(F.max_by(F.struct(ts, *columns), F.struct(ts, order)).alias("x"), F.count("*").alias("n_updates"))
    return last.select(key, "x.*", "n_updates")


def stale(agents: DataFrame, as_of: Column, seconds: int, seen: str = "last_seen") -> DataFrame:
    idle = (F.unix_micros(as_of) - F.unix_micros(F.col(seen).cast("timestamp"))) / 1e6
    return agents.where(F.col("status").isin("idle", "working")).withColumn("idle_seconds", idle).where(F.col("idle_seconds") > seconds)


def retry_or_fail(assignments: DataFrame, most: int = 3) -> DataFrame:
    """Assignments of stale agents: pending again with a hint while tries are left, else failed."""
    from palimpsest.functions.text import failure_mode, retry_hint

    again = F.col("attempts") < most
    mode = failure_mode(F.col("result"))
    return assignments.withColumn("status", F.when(again, "pending").otherwise("failed")).withColumn("mode", mode).withColumn("hint", F.when(again, retry_hint(mode))).withColumn("attempts", F.col("attempts") + F.when(again, 1).otherwise(0))


def lock_holders(requests: DataFrame) -> DataFrame:
    """Lock requests (path, agent, ts, event_id): the first agent of a path holds it; others conflict."""
    first = requests.groupBy("path").agg(F.min_by("agent", F.struct("ts", "event_id")).alias("holder"))
    return requests.join(first, "path").withColumn("granted", F.col("agent") == F.col("holder"))


def active_commands(commands: DataFrame) -> DataFrame:
    """Commands after the last RESUME of their workspace (one without workspace resumes all), strongest first."""
    resumed = commands.where("command = 'RESUME'").groupBy("workspace").agg(F.max("ts").alias("cleared"))
    every = commands.where("command = 'RESUME' and workspace is null").agg(F.max("ts").alias("cleared_all"))
    live = commands.where("command != 'RESUME'").join(resumed, "workspace", "left").join(F.broadcast(every))
    live = live.where((F.col("cleared").isNull() | (F.col("ts") > F.col("cleared"))) & (F.col("cleared_all").isNull() | (F.col("ts") > F.col("cleared_all"))))
    return live.drop("cleared", "cleared_all").orderBy(ranked_by("command", ("SHUTDOWN", "BUILD_FREEZE", "PAUSE")), F.desc("ts"), "id")


def mailbox(messages: DataFrame, most: int = 10) -> DataFrame:
    """The oldest undelivered messages of each receiver."""
    w = Window.partitionBy("receiver").orderBy("ts", "id")
    return messages.where(~F.col("delivered")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def timeline(events: DataFrame, agents: DataFrame, tasks: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events with their agent's name and current task; the cut comes before the joins."""
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
    a = agents.select(F.col("id").alias("agent"), "name", "current_task")
    t = tasks.select(F.col("id").alias("current_task"), F.col("status").alias("task_status"))
    return last.join(a, "agent", "left").join(t, "current_task", "left")


def feed(events: DataFrame, since_id: int, limit: int = 50) -> DataFrame:
    return events.where(F.col("event_id") > since_id).orderBy("event_id").limit(limit)


def deep_health(n_stale: DataFrame, healthy: bool = True) -> DataFrame:
    """One row from a one-row count."""
    return n_stale.select("n", F.when((F.col("n") > 2) | ~F.lit(healthy), "degraded").otherwise("ok").alias("status"))


def delivery_rate(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("agent").agg(F.sum("delivered").alias("delivered"), F.sum("attempts").alias("attempts")).withColumn("delivery_rate", F.when(F.col("attempts") > 0, F.col("delivered") / F.col("attempts")).otherwise(0.0))


def prometheus(rows: DataFrame, metric: str, labels: tuple[str, ...], value: str, help_text: str = "") -> DataFrame:
    """Exposition lines of one metric: (line_no, line)."""
    label = F.concat_ws(",", *[F.format_string(f'{c}="%s"', F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1")) for c in labels])
    line = F.concat(F.lit(metric), F.lit("{"), label, F.lit("} "), F.col(value).cast("string"))
    head = rows.sparkSession.createDataFrame([(0, f"# HELP {metric} {help_text}"), (1, f"# TYPE {metric} gauge")], "line_no int, line string")
    return head.unionByName(rows.select(F.lit(2).alias("line_no"), line.alias("line")))


def peer_decisions(decisions: DataFrame, agents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Others' decisions that mention any keyword of the query, newest first."""
    from palimpsest.functions.text import keywords

    low = F.lower("text")
    hit = F.exists(keywords(F.lit(query)), lambda k: F.contains(low, k))
    return decisions.where(hit).join(agents.select(F.col("id").alias("agent"), "name"), "agent").orderBy(F.desc("ts"), "id").limit(limit)
