"""The write path: novelty, salience, create, reinforce, supersede, and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.operators import nearest
from palimpsest.sources.shared import Scratch, stored

#: Fixed values of the write path.
HEALTHY_CONFIDENCE, REINFORCE_STEP, REINFORCE_CEILING = 0.3, 0.05, 0.95
TOUCH_CEILING, CONTENT_LIMIT, RECENT_DAYS = 0.85, 1500, 30


def best_text_match(writes: DataFrame, memories: DataFrame, most: int = 3) -> DataFrame:
    """(write_id, id, score, same_concept): the best of the ``most`` best matches by the share
    of the write's terms that a memory of the same agent holds, weighted by rarity.

    Every term counts, also one that all memories hold; terms that none holds do not."""
    live = memories.where("not retracted")
    w = writes.select(F.col("write_id").cast("long").alias("id"), "agent", F.explode(hashed(T.search_terms(F.concat_ws(" ", "concept", F.substring("content", 1, 100))))).alias("term"))
    m = live.select("agent", F.col("id").cast("long").alias("id"), hashed(T.index_terms(F.concat_ws(" ", "concept", "content"))).alias("terms"))
    with Scratch(memories.sparkSession) as scratch:
        m = scratch.stored(m, "terms")  # texts are split once
        df = m.select("agent", F.explode("terms").alias("term")).groupBy("agent", "term").agg(F.count("*").alias("df"))
        n = live.groupBy("agent").agg(F.count("*").alias("n"))
        idf = df.join(w.select("agent", "term").distinct(), ["agent", "term"], "left_semi").join(F.broadcast(n), "agent").select("agent", "term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
        held = w.join(idf, ["agent", "term"]).groupBy("agent", "id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("x"))
        total = F.aggregate("x.idf", F.lit(0.0), lambda a, x: a + x)
        queries = held.withColumn("total", total).select("agent", "id", F.col("x.term").alias("terms"), F.transform("x.idf", lambda x: x / F.col("total")).alias("weights"))
        queries = scratch.stored(queries, "writes")  # they are counted and dealt
        top = heaviest_overlaps(queries, m, most, others=False).groupBy("query").agg(F.max_by(F.struct("id", "s"), F.struct(F.round("s", 9), -F.col("id"))).alias("x"))
        top = stored(top.select(F.col("query").alias("write_id"), "x.id", F.col("x.s").alias("score")), "matches")
    named = top.join(writes.select("write_id", F.col("concept").alias("__new")), "write_id").join(live.select("id", "concept"), "id")
    return named.select("write_id", "id", "score", (F.lower(F.trim("__new")) == F.lower(F.trim("concept"))).alias("same_concept"))


def best_vector_match(writes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(write_id, id, score): the memory of the same agent with the largest cosine."""
    asked = writes.select(F.col("write_id").alias("query"), F.col("write_id").alias("self"), "vector", F.col("agent").alias("list"))
    best = nearest.exact(asked, vectors.select("id", F.col("agent").alias("list"), "vector"), 1, places=6)
    return best.select(F.col("query").alias("write_id"), "id", F.col("similarity").alias("score"))


def scored_writes(writes: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Writes (content, event_type, signals, novelty) with score, disposition, reasons and first confidence.
    ``names`` are the people whose words count as feedback."""
    c = F.col("content")
    out = writes.withColumn("s", S.salience("surprise", F.col("decision_made"), "causal_depth", "resolution_effort", "novelty", F.col("event_type"), F.col("memory_class"), T.is_verified_record(c), T.is_routine(c), T.is_feedback(c, names)))
    out = out.select(*writes.columns, F.col("s.score").alias("score"), F.col("s.disposition").alias("disposition"), F.col("s.reasons").alias("reasons"))
    return out.withColumn("confidence", S.prior_confidence(F.col("disposition"), F.coalesce("event_type", F.lit("observation"))))


def reinforced(memories: DataFrame, additions: DataFrame) -> DataFrame:
    """Memories after one addition each (id, content): more confident, touched, content appended."""
    a = additions.select("id", F.col("content").alias("__new"))
    c = F.least(F.lit(REINFORCE_CEILING), F.col("confidence") + REINFORCE_STEP)
    return memories.join(a, "id").select("id", S.touched_confidence(c, "access_count").alias("confidence"), (F.col("access_count") + 1).alias("access_count"), T.merge_content(F.col("content"), F.col("__new"), CONTENT_LIMIT).alias("content"))


def superseded_confidence(confidence: Column, policy: str) -> Column:
    """What a superseded memory keeps, by how it was superseded."""
    return {"by_id": confidence * 0.2, "by_tool": F.greatest(F.lit(0.2), confidence * 0.4), "batch": F.lit(0.1), "write": confidence}[policy]


def superseded(memories: DataFrame, pairs: DataFrame, policy: str = "by_id") -> tuple[DataFrame, DataFrame]:
    """(memories, new causal edges) after (old, new) pairs."""
    p = pairs.select(F.col("old").alias("id"), F.col("new").alias("__new"))
    both = memories.join(p, "id", "left")
    hit = F.col("__new").isNotNull()
    rows = both.withColumn("confidence", F.when(hit, superseded_confidence(F.col("confidence"), policy)).otherwise(F.col("confidence"))).withColumn("superseded_by", F.coalesce("__new", "superseded_by"))
    if policy == "batch":
        rows = rows.withColumn("stage", F.when(hit, "archived").otherwise(F.col("stage")))
    edges = pairs.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("causal").alias("type"), F.lit(0.8).alias("weight"), F.lit(1.0).alias("confidence"))
    return rows.drop("__new"), edges


_FOLD = "agent string, key string, write_id long, action string, target long, confidence double, access_count long, content string"


def folded_writes(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """What each write does, in order, to its concept: create, reinforce or supersede.

    A write meets the state that earlier writes of its concept left, so a concept's writes
    are folded in order.  They are sorted in Spark and streamed; the state is one memory.
    """
    key = F.lower(F.trim("concept"))
    live = memories.where("stage = 'active' and not retracted and superseded_by is null")
    newest = live.select("agent", key.alias("key"), F.struct("created_at", "id", F.col("confidence").cast("double").alias("confidence"), F.col("access_count").cast("long").alias("access_count"), "content").alias("m")).groupBy("agent", "key").agg(F.max("m").alias("m"))
    w = writes.select("agent", key.alias("key"), F.col("write_id").cast("long").alias("write_id"), "content", F.col("confidence").cast("double").alias("confidence"))
    both = w.join(newest, ["agent", "key"], "left").select("agent", "key", "write_id", "content", "confidence", F.col("m.id").alias("mid"), F.col("m.confidence").alias("mconf"), F.col("m.access_count").alias("mcount"), F.col("m.content").alias("mtext"))
    ordered = both.repartition("agent", "key").sortWithinPartitions("agent", "key", "write_id")

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["agent"], r["key"]) != now:
                    now = (r["agent"], r["key"])
                    state = [r["mid"], r["mconf"], r["mcount"], r["mtext"] or ""] if r["mid"] is not None else None
                if state is not None and state[1] >= HEALTHY_CONFIDENCE:
                    n, c = state[2], min(REINFORCE_CEILING, state[1] + REINFORCE_STEP)
                    c = min(TOUCH_CEILING, c + 0.02 / (1 + n**0.5))
                    state = [state[0], c, n + 1, merged(state[3], r["content"] or "")]
                    out.append((*now, r["write_id"], "reinforce", *state))
                else:
                    action = "create" if state is None else "supersede"
                    old = None if state is None else state[0]
                    state = [r["write_id"], r["confidence"], 0, r["content"] or ""]
                    out.append((*now, r["write_id"], action, old, *state[1:]))
            names = [f.split()[0] for f in _FOLD.split(", ")]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names=names)

    return ordered.mapInArrow(fold, _FOLD)


def merged(old: str, new: str, most: int = CONTENT_LIMIT) -> str:
    """One content after an addition: see functions.text.merge_content."""
    new = new.strip(" ")
    if not new or new in old:
        return old
    parts = [*old.split(T.SEPARATOR), new]
    while len(parts) > 1 and len(T.SEPARATOR.join(parts)) > most:
        parts.pop(0)
    return T.SEPARATOR.join(parts)


def evicted(memories: DataFrame, as_of: Column, max_active: int) -> DataFrame:
    """(id) of each agent's least valuable active memories beyond its limit."""
    live = memories.where("stage = 'active' and not retracted")
    score = S.eviction_score("salience", "confidence", "access_count", S.days_between(as_of, F.col("last_accessed")))
    w = Window.partitionBy("agent").orderBy(F.desc("score"), F.desc("id"))
    return live.withColumn("score", F.round(score, 9)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") > max_active).select("id", "agent", "score")


#: What a new memory has where nothing is given.
DEFAULTS = {"confidence": 0.5, "salience": 0.5, "stage": "active", "memory_class": "working", "memory_type": "unclassified", "access_count": 0, "retracted": False}


def inserted(memories: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """The memories with new rows, which need id, agent, concept and content; other columns are
    taken where given and not null, else from DEFAULTS, the time asked, or null."""
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None)

    def value(f):
        default = as_of if f.name in ("created_at", "last_accessed") else F.array().cast(f.dataType) if f.name in ("tags", "refs") else F.lit(DEFAULTS.get(f.name))
        return F.coalesce(given(f.name).cast(f.dataType), default.cast(f.dataType)).alias(f.name)

    return memories.unionByName(rows.select(*map(value, memories.schema.fields)))


def over_staging_budget(memories: DataFrame, as_of: Column, most: int = 1000) -> DataFrame:
    """(id, agent) of the expired staged memories that go once any agent has more than ``most`` staged
    ones: then those of all agents do."""
    full = memories.where("stage = 'staging' and not retracted").groupBy("agent").count().where(F.col("count") > most).agg((F.count("*") > 0).alias("full"))
    return expired_staging(memories, as_of).join(F.broadcast(full.where("full"))).select("id", "agent")  # one row, or none


def expired_staging(memories: DataFrame, as_of: Column) -> DataFrame:
    """Staged memories whose time to live is over; a ttl of 0 or none never ends."""
    end = F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("ttl_ms") * 1000
    return memories.where((F.col("stage") == "staging") & (F.coalesce("ttl_ms", F.lit(0)) > 0) & (end < F.unix_micros(as_of)))


def swept_staging(expired: DataFrame, similarity: DataFrame, as_of: Column, least: float = 0.6) -> DataFrame:
    """Expired memories with what happens to them: promoted if something active is similar enough,
    deleted if a day old, else kept.  ``similarity`` is (id, score), never of a memory with itself."""
    age = S.days_between(as_of, F.col("created_at"))
    action = F.when(F.coalesce("score", F.lit(0.0)) >= least, "promoted").when(age > 1, "discarded").otherwise("kept")
    return expired.join(similarity, "id", "left").select("id", "agent", F.coalesce("score", F.lit(0.0)).alias("score"), action.alias("action"))


def heaviest_overlaps(queries: DataFrame, data: DataFrame, most: int, block: int = 16384, others: bool = True) -> DataFrame:
    """(query, id, s): for each query the ``most`` rows of its agent whose shared terms weigh most,
    ties to the smallest id; ``others`` leaves out the row with the query's own id.  ``queries`` is (agent, id, terms, weights), ``data`` (agent, id, terms);
    terms are distinct 64-bit hashes.

    Rows are dealt to blocks; a block of queries and one of data meet in one task, which multiplies
    them as sparse matrices and keeps the ``most`` best of each query.  However common a term is, no
    pair leaves a task but these."""

    def dealt(own: DataFrame, name: str, most_at_once: int, least_blocks: int) -> tuple[DataFrame, DataFrame]:
        n = own.groupBy("agent").agg(F.count("*").alias("n"))
        n = n.select("agent", F.greatest(F.ceil(F.col("n") / most_at_once), F.least(F.lit(least_blocks), F.ceil(F.col("n") / 512))).cast("int").alias(f"{name}s"))
        return own.join(F.broadcast(n), "agent").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), n

    known = "agent is not null and id is not null"
    left, lefts = dealt(queries.where(known).select("agent", "id", "terms", "weights"), "i", block, 1)
    right, rights = dealt(data.where(known).select("agent", "id", "terms"), "j", block, 16)
    every = lambda df, n, name: df.join(F.broadcast(n), "agent").withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1))).drop(f"{name}s")

    def multiply(key, q, d):
        import numpy as np
        import pyarrow as pa

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and d.num_rows:
            q, d = q.combine_chunks(), d.sort_by("d_id").combine_chunks()
            of = lambda t, c: t.column(c).combine_chunks()
            ids, own = of(q, "id").to_numpy(), of(d, "d_id").to_numpy()
            row = np.repeat(np.arange(len(own)), of(d, "d_terms").value_lengths().to_numpy())
            term = of(d, "d_terms").flatten().to_numpy()
            order = np.argsort(term, kind="stable")
            term, row = term[order], row[order]
            asked, weight = of(q, "terms").flatten().to_numpy(), of(q, "weights").flatten().to_numpy()
            who = np.repeat(np.arange(len(ids)), of(q, "terms").value_lengths().to_numpy())
            begin = np.searchsorted(term, asked, "left")
            n = np.searchsorted(term, asked, "right") - begin
            who, begin, n, weight = who[n > 0], begin[n > 0], n[n > 0], weight[n > 0]
            first = np.searchsorted(who, np.arange(len(ids) + 1))
            cost = np.concatenate([[0], np.cumsum(n)])[first]  # postings before each query
            a = 0
            while a < len(ids):
                b = max(a + 1, min(int(np.searchsorted(cost, cost[a] + (1 << 20), "right")) - 1, a + max(1, (1 << 20) // len(own)), len(ids)))
                s = slice(first[a], first[b])
                m = n[s]
                at = np.repeat(begin[s] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                cell = np.repeat((who[s] - a) * len(own), m) + row[at]
                score = np.bincount(cell, np.repeat(weight[s], m), (b - a) * len(own)).reshape(b - a, len(own))
                rank = np.rint(score * 1e9).astype(np.int64)
                if others:
                    place = np.minimum(np.searchsorted(own, ids[a:b]), len(own) - 1)
                    same = np.flatnonzero(own[place] == ids[a:b])
                    rank[same, place[same]] = 0
                live = np.arange(b - a)
                for _ in range(most):
                    best = rank[live].argmax(1) if len(live) < b - a else rank.argmax(1)  # the first of equals: the smallest id
                    some = rank[live, best] > 0
                    live, best = live[some], best[some]
                    if not len(live):
                        break
                    out.append((ids[a:b][live], own[best], score[live, best]))
                    rank[live, best] = 0
                a = b
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query", "id", "s"), zip(*out))})

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not put together by their bytes: the work is that of pairs
    left = every(left, rights, "j").repartition(parts, "agent", "i", "j")
    right = every(right, lefts, "i").toDF(*(f"d_{c}" for c in ("agent", "id", "terms", "j", "i"))).repartition(parts, "d_agent", "d_i", "d_j")
    met = left.groupBy("agent", "i", "j").cogroup(right.groupBy("d_agent", "d_i", "d_j")).applyInArrow(multiply, "query long, id long, s double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "id")
    return met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def most_shared(data: DataFrame, sizes: DataFrame, most: int, block: int = 1 << 17, asked: int = 1 << 13, budget: int = 2048) -> DataFrame:
    """(query, id, k): for each row of (agent, id, terms) the ``most`` other rows of its agent that share most terms, ties to the
    smallest id; terms are distinct 64-bit hashes.  ``sizes`` is (agent, n), n the agent's rows or more.

    Rows are dealt to blocks, and each block asks each.  A row that shares s of m terms holds one of any m - s + 1 of them, so
    only the postings of a query's rarest terms are read; the others must be among the block's most common, of which each row
    has a bit.  What s is worth looking for is seen first, from rare terms with up to ``budget`` postings.  The work still
    grows with the square of an agent's rows, but only where rows share their rarer terms."""
    n = F.col("n")
    deal = sizes.select("agent", F.greatest(F.ceil(n / block), F.least(F.lit(12), F.ceil(n / asked))).cast("int").alias("is"), F.ceil(n / block).cast("int").alias("js"))
    part = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")
    own = data.join(F.broadcast(deal), "agent").withColumn("i", part(1, "is")).withColumn("j", part(2, "js"))
    place = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    asks = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: place(F.col("i"), j, True))
    held = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: place(i, F.col("j"), False))
    met = own.select("agent", "id", "terms", F.explode(F.concat(asks, held)).alias("at")).select("agent", "id", "terms", "at.i", "at.j", "at.asks")

    def meet(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        arrays = lambda t: (t.column("id").to_numpy(), (x := t.column("terms").combine_chunks()).flatten().to_numpy(), x.value_lengths().to_numpy())
        ids, asked, n_asked = arrays(t.filter(t.column("asks")))
        own, term, n_own = arrays(t.filter(pc.invert(t.column("asks"))).sort_by("id"))
        out = [(np.zeros(0, np.int64),) * 3]
        row = np.repeat(np.arange(len(own)), n_own)
        order = np.argsort(term, kind="stable")
        term, row = term[order], row[order]  # the postings of the block's terms
        begin = np.searchsorted(term, asked, "left")
        df = np.searchsorted(term, asked, "right") - begin
        who = np.repeat(np.arange(len(ids)), n_asked)

        # a bit for each of the most common terms
        first = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else np.zeros(0, np.int64)
        size = np.diff(first, append=len(term))
        head = np.argsort(-size, kind="stable")[:HEAD_TERMS]
        bits = np.zeros((HEAD_TERMS // 64, len(own)), np.uint64)
        for h, x in enumerate(head):
            bits[h // 64, row[first[x] : first[x] + size[x]]] |= np.uint64(1 << h % 64)
        at = np.argsort(first[head])
        found = np.minimum(np.searchsorted(first[head][at], begin), max(len(head) - 1, 0))
        common = np.where((first[head][at][found] == begin) & (df > 0), at[found], -1) if len(head) else np.full(len(begin), -1)

        # a query's terms that the block has, the rarest first
        order = np.lexsort((df, who))
        order = order[df[order] > 0]
        begin, df, who, common = begin[order], df[order], who[order], common[order]
        start = np.searchsorted(who, np.arange(len(ids) + 1))
        m, place = np.diff(start), np.arange(len(who)) - start[who]
        passed = np.cumsum(df) - (np.cumsum(df) - df)[start[who]]  # postings of a query up to this term

        def shared(upto):
            """Batches (first query, number of queries, query, row, terms shared) by postings of the first ``upto`` terms, and by bits
            of the rest; the query's own row is among them."""
            used = place < upto[who]
            cost = np.concatenate([[0], np.cumsum(np.bincount(who[used], df[used], len(ids)))])
            rest = np.zeros((HEAD_TERMS // 64, len(ids)), np.uint64)
            s = ~used & (common >= 0)
            np.bitwise_or.at(rest, (common[s] // 64, who[s]), np.uint64(1) << (common[s] % 64).astype(np.uint64))
            a = 0
            while a < len(ids):
                b = max(a + 1, min(int(np.searchsorted(cost, cost[a] + (1 << 20), "right")) - 1, a + (1 << 13)))
                s = np.flatnonzero(used[start[a] : start[b]]) + start[a]
                k = df[s]
                pair = np.repeat((who[s] - a) << ROW_BITS, k) | row[np.repeat(begin[s] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
                pair.sort()
                new = np.flatnonzero(np.concatenate([pair[:1] >= 0, pair[1:] != pair[:-1]]))
                k = np.diff(new, append=len(pair))
                pair = pair[new]
                q, d = pair >> ROW_BITS, pair & ((1 << ROW_BITS) - 1)
                for x, y in zip(bits, rest[:, a:b]):
                    if y.any():
                        k += np.bitwise_count(x[d] & y[q])
                yield a, b - a, q, d, k
                a = b

        # at least so many are shared with each of the best: a bound from below
        least, itself = np.zeros(len(ids), np.int64), np.isin(ids, own)
        for a, n, q, _, k in shared(np.maximum(np.bincount(who[passed <= budget], minlength=len(ids)), 1)):
            some = np.bincount(q * 128 + np.minimum(k, 127), minlength=n * 128).reshape(n, 128)
            least[a : a + n] = (np.cumsum(some[:, ::-1], 1)[:, ::-1] >= most + itself[a : a + n, None]).sum(1) - 1
        least = np.maximum(least, 0)
        last = np.zeros(len(ids), np.int64)  # after the last term without a bit
        np.maximum.at(last, who[common < 0], place[common < 0] + 1)
        for a, n, q, d, k in shared(np.minimum(m, np.maximum(m - np.maximum(least, 1) + 1, last))):
            s = k >= least[a + q]
            q, d, k = q[s], d[s], k[s]
            s = own[d] != ids[a + q]
            q, d, k = q[s], d[s], k[s]
            s = np.lexsort((d, -k, q))
            q, d, k = q[s], d[s], k[s]
            s = np.arange(len(q)) - np.searchsorted(q, q) < most
            out.append((ids[a + q[s]], own[d[s]], k[s]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query", "id", "k"), zip(*out))})

    # a fixed number of parts: blocks are few bytes and much work, and would else be put together into few tasks
    best = met.repartition(96, "agent", "i", "j").groupBy("agent", "i", "j").applyInArrow(meet, "query long, id long, k long")
    w = Window.partitionBy("query").orderBy(F.desc("k"), "id")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


HEAD_TERMS = 128  # terms of a block that have a bit in each of its rows
ROW_BITS = 32  # a row of a block has a number of fewer bits


def hashed(terms: Column) -> Column:
    """Distinct terms as 64-bit hashes: of N, two different ones count as equal with odds of about N^2 / 2^65."""
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def entity_edges(memories: DataFrame, most: int = 6) -> DataFrame:
    """Edges between memories of an agent that name the same entities, at most ``most`` from each.

    Every shared entity counts, however many memories name it."""
    live = memories.where("stage = 'active' and not retracted and agent is not null and id is not null")
    e = live.select("agent", F.col("id").cast("long").alias("id"), hashed(T.entities(F.concat_ws(" ", "concept", "content"))).alias("terms"))
    top = most_shared(e, live.groupBy("agent").agg(F.count("*").alias("n")), most)
    return top.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit("connection").alias("type"), F.least(F.lit(0.6), 0.4 + 0.1 * F.col("k")).alias("weight"), "k")


def discovered_links(vectors: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """Connection edges of each memory to its ``most`` most similar ones of the agent, both ways."""
    own = vectors.select(F.col("agent").alias("list"), "id", "vector")
    near = nearest.exact(own.withColumn("query", F.col("id")).withColumn("self", F.col("id")), own, most, least - 1e-6, places=6)
    top = near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= least)
    return top.unionByName(top.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity")).distinct().select("src", "dst", F.lit("connection").alias("type"), F.col("similarity").alias("weight"))


def context_memories(assignments: DataFrame, schema: str = "k int") -> DataFrame:
    """Canonical memories from assignments (id, agent, context as JSON); what is no JSON object is left out."""
    own = assignments.select("id", "agent", F.from_json("context", schema).alias("c"), "context").where("c is not null")
    return own.select(F.col("id"), F.col("agent"), F.concat(F.lit("context of "), F.col("id").cast("string")).alias("concept"), F.to_json("c").alias("content"), F.lit("canonical").alias("memory_class"), F.lit(0.7).alias("salience"))
