"""Query expansion by a table of associated terms, in place of a generating model.

Two terms are associated when they stand near each other more often than their frequencies
let one expect: positive pointwise mutual information of counts within a few words.  The table is
counted over all texts and pruned to a few terms each, so a lookup reads a handful of rows.

Defined results: null texts have no terms; a query that is empty, long or of many words stays as it is, and so does
one without associated terms; null queries give null; ties go to the larger count, then to the smaller term.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.sources.shared import stored


def _terms(text: Column) -> Column:
    """Meaningful words in order, repeats kept."""
    return F.filter(T._words(text), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOPWORDS))


BUCKET_BYTES = 8 << 20  # of text to a bucket of pairs
WORDS_AT_ONCE = 2 << 20  # words of texts whose pairs are counted together before they are shuffled
SHORT_CODES, SAMPLE_BYTES = 1 << 16, 16 << 20  # words that are frequent in a sample of this size have short codes; no result depends on it


def _counted_near(words: DataFrame, reach: int, buckets: int, frequent: list[str]) -> DataFrame:
    """Blocks of counts of a column of words: rows with ``b`` hold pairs of word codes (a < b) and how often they stand
    near each other, rows with ``word`` hold words, their codes in ``a`` and how many ends of such pairs they are.
    A code is the place among ``frequent``, else a negative hash; blocks are ``size`` compressed longs."""

    def counted(lists: list, short: dict[str, int]) -> Iterator:
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        doc = np.repeat(np.arange(sum(map(len, lists))), np.concatenate([x.value_lengths().to_numpy() for x in lists]))
        coded = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        known = coded.dictionary
        means = pc.and_(pc.greater(pc.utf8_length(known), 2), pc.invert(pc.is_in(known, pa.array(T.STOPWORDS)))).to_numpy(zero_copy_only=False)
        code_of = lambda w: -1 - (int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") >> 1)
        h = np.array([0 if not m else short[w] if w in short else code_of(w) for w, m in zip(known.to_pylist(), means)], np.int64)
        order = np.argsort(h, kind="stable")  # places in the order of codes: a pair lies the same way in every block
        code = np.empty(len(h), np.int64)
        code[order] = np.arange(len(h))
        h, known = h[order], known.take(pa.array(order))
        at = coded.indices.to_numpy()
        at, doc = code[at][means[at]], doc[means[at]]
        keys = []
        for d in range(1, reach + 1):
            x, y = at[:-d], at[d:]
            near = (doc[:-d] == doc[d:]) & (x != y)
            x, y = x[near], y[near]
            keys.append(np.minimum(x, y) * len(h) + np.maximum(x, y))
        key = np.sort(np.concatenate(keys))
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        lo, hi = np.divmod(key[first], len(h))
        own = (np.bincount(lo, n, len(h)) + np.bincount(hi, n, len(h))).astype(np.int64)

        def block(part: object, size: int) -> tuple:
            order = np.argsort(part.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
            part = part[order]
            cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), size)

            def packed(x: object) -> object:
                x = x[order]
                return pa.array([zstd.compress(x[i:j], asbytes=True) for i, j in zip(cut[:-1], cut[1:])], pa.binary())

            return order, cut, [pa.array(part[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut).astype(np.int32))], packed

        zstd = pa.Codec("zstd", 1)
        mixed = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        spread = lambda x: (x * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29)) % np.uint64(buckets)
        a, b = h[lo], h[hi]
        _, _, (where, size), packed = block(spread(mixed[lo] ^ mixed[hi] >> np.uint64(7)), len(a))
        none = lambda kind, n: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([where, size, packed(a), packed(b), packed(n.astype(np.int64)), none(pa.list_(pa.string()), len(where))], names=names)
        some = np.flatnonzero(own)
        order, cut, (where, size), packed = block(spread(mixed[some]), len(some))
        texts = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), known.take(pa.array(some[order])).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([where, size, packed(h[some]), none(pa.binary(), len(where)), packed(own[some]), texts], names=names)

    def run(batches: Iterator) -> Iterator:
        held, n, short = [], 0, {w: i for i, w in enumerate(frequent)}
        for batch in batches:
            at = 0
            ends = batch.column(0).offsets.to_numpy()
            while at < batch.num_rows:  # whole texts, up to the words that are counted together
                to = max(at + 1, int(ends.searchsorted(ends[at] + WORDS_AT_ONCE - n, "right")) - 1)
                held.append(batch.column(0).slice(at, to - at))
                n, at = n + int(ends[to] - ends[at]), to
                if n >= WORDS_AT_ONCE or at < batch.num_rows:
                    yield from counted(held, short)
                    held, n = [], 0
        if held:
            yield from counted(held, short)

    names = ["bucket", "size", "a", "b", "n", "word"]
    return words.mapInArrow(run, "bucket int, size int, a binary, b binary, n binary, word array<string>")


def _near_counts(memories: DataFrame, content: str, reach: int, least: int) -> DataFrame:
    """(a, b, n, word): pairs of word codes with their counts of ``least`` or more; words (b is null) with the number of
    pairs' ends; and rows of neither with that number for words that are in no such pair.

    Words go by 63-bit hashes: of N, two different ones count as equal with odds of about N^2 / 2^64."""
    texts = memories.where(F.col(content).isNotNull())
    size = texts.agg(F.sum(F.octet_length(content))).first()[0] or 0
    buckets = max(memories.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))

    def summed(t):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        zstd = pa.Codec("zstd")
        longs = lambda x, c: pa.array(np.frombuffer(b"".join(zstd.decompress(v, 8 * n, asbytes=True) for v, n in zip(x.column(c).to_pylist(), x.column("size").to_pylist())), np.int64))
        pair = t.filter(pc.is_valid(t.column("b")))
        p = pa.table({c: longs(pair, c) for c in "abn"}).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
        p = p.filter(pc.greater_equal(p.column("n_sum"), least))
        word = t.filter(pc.is_null(t.column("b")))
        w = pa.table({"a": longs(word, "a"), "n": longs(word, "n"), "word": pc.list_flatten(word.column("word"))}).group_by(["a", "word"], use_threads=False).aggregate([("n", "sum")])
        often = pc.greater_equal(w.column("n_sum"), least)
        rare = pc.sum(w.filter(pc.invert(often)).column("n_sum")).as_py() or 0
        w = w.filter(often)
        none = lambda n, kind: pa.chunked_array([pa.nulls(n, kind)])
        return pa.concat_tables([
            pa.table({"a": p.column("a"), "b": p.column("b"), "n": p.column("n_sum"), "word": none(len(p), pa.string())}),
            pa.table({"a": w.column("a"), "b": none(len(w), pa.int64()), "n": w.column("n_sum"), "word": w.column("word")}),
            pa.table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "n": pa.array([rare]), "word": pa.nulls(1, pa.string())}),
        ])

    some = texts.sample(min(1.0, SAMPLE_BYTES / max(size, 1)), 7).select(F.explode(_terms(F.col(content))).alias("w")).groupBy("w").count()
    frequent = [r["w"] for r in some.orderBy(F.desc("count"), "w").limit(SHORT_CODES).select("w").collect()]
    blocks = _counted_near(texts.select(T._words(F.col(content)).alias("w")), reach, buckets, frequent)
    return stored(blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(summed, "a long, b long, n long, word string"), "near-terms")


def associations(memories: DataFrame, content: str = "content", reach: int = 4, least: int = 3, most: int = 5) -> DataFrame:
    """(term, other, n, ppmi): for each term the ``most`` others of highest information among those that stand within
    ``reach`` words of it ``least`` times or more.  Pairs are counted in blocks of words, shuffled once as packed counts into
    buckets whose number grows with the texts, and only those of ``least`` or more are joined with their words; work grows with the words."""
    counts = _near_counts(memories, content, reach, least)
    total = counts.where("b is null").agg(F.sum("n").alias("total"))  # one row
    of = lambda key, word, own: counts.where("word is not null").select(F.col("a").alias(key), F.col("word").alias(word), F.col("n").alias(own))
    often = counts.where("b is not null").drop("word").join(of("a", "x", "own"), "a").join(of("b", "y", "others"), "b").join(F.broadcast(total))
    scored = often.select("x", "y", "n", F.round(F.log(F.col("n").cast("double") * F.col("total") / (F.col("own").cast("double") * F.col("others"))), 6).alias("ppmi")).where("ppmi > 0")
    both = scored.select(F.explode(F.array(F.struct(F.col("x").alias("term"), F.col("y").alias("other")), F.struct(F.col("y").alias("term"), F.col("x").alias("other")))).alias("e"), "n", "ppmi").select("e.*", "n", "ppmi")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ppmi"), F.desc("n"), "other"))  # cut in each partition before the shuffle
    return both.withColumn("place", place).where(F.col("place") <= most).drop("place")


def is_specific(text: Column) -> Column:
    """Queries that are not expanded: empty, over 50 characters, or of five distinct words of three letters or more."""
    norm = F.lower(F.trim(text))
    words = F.array_distinct(F.filter(F.split(norm, r"\s+"), lambda w: F.length(w) > 2))
    return (norm == "") | (F.length(norm) > 50) | (F.size(words) >= 5)


def expanded(queries: DataFrame, associated: DataFrame, text: str = "text", most: int = 5) -> DataFrame:
    """Queries (id, text) with ``expanded``: the text and the ``most`` terms that its terms are most associated with."""
    asked = queries.where(~is_specific(F.col(text))).select("id", F.array_distinct(_terms(F.col(text))).alias("own"))
    hits = asked.select("id", "own", F.explode("own").alias("term")).join(associated, "term").where(~F.array_contains("own", F.col("other")))
    sums = hits.groupBy("id", "other").agg(F.round(F.sum("ppmi"), 6).alias("s"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))
    best = sums.withColumn("place", place).where(F.col("place") <= most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x.other), " ").alias("__more"))
    return queries.join(best, "id", "left").withColumn("expanded", F.when(F.col("__more").isNull(), F.col(text)).otherwise(F.concat(F.col(text), F.lit(" "), F.col("__more")))).drop("__more")
