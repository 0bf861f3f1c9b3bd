"""From crawled documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor
kept; all but the last return the columns of ``documents``.  A stage's result is
written as Parquet and read again by the next one; what a stage stores for itself it
deletes, but for a small table of verdicts.

Rows are judged one by one.  The operators see the columns under numbers, so extra
columns may have any name, and a null or repeated doc_id is no row's key: verdicts
are bound to the id together with a hash of the text, or to the text alone.  A null
text counts as empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, ngram_join, pii, quality
from palimpsest.llm._io import stored, table
from palimpsest.llm.queries import THRESHOLD, contaminated

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Verdicts (tens of bytes each) that are broadcast at most; more of them are joined by a shuffle.
MAX_BROADCAST = 200_000
LAST = (1 << 63) - 1  # stands for a null id, after all others
#: Rows that go to Python at once: texts are long, and the default of 10,000 takes tens of megabytes a batch.
ROWS_AT_ONCE = "500"


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The table with columns c0, c1, ..., and the numbered names of doc_id and text.  From
    here on the session hands rows to Python by ROWS_AT_ONCE."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in a stored table of verdicts."""
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, keys, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each by its own text."""
    own, key, text = numbered(docs)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(own, model, key, text, keep=tuple(own.columns))
    return scored.where(F.col("score") >= THRESHOLD).select(*own.columns).toDF(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id (null
    comes last), and of several texts under that id the one with the least hash; of rows
    with that id and that text one.  Rows without words are linked with nothing and all stay."""
    own, key, text = numbered(docs)
    marked = own.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn("__hash", F.xxhash64(text))
    found = ngram_join.join(marked, SHINGLE_WORDS, SIMILARITY_PERCENT, "__id", text, keep=("__hash",))
    rows = found.where("component is not null").groupBy("component", "__id", "__hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("__id", "__hash")).alias("first"), F.sum("n").alias("of")).where("of > 1").select("component", "first")
    other = rows.join(first, "component").withColumn("stays", F.struct("__id", "__hash") == F.col("first")).where("not stays or n > 1")
    verdicts = stored(other.select("__id", "__hash", "stays"), "duplicates")
    left = without(marked, verdicts.select("__id", "__hash"), ["__id", "__hash"])
    again = verdicts.where("stays").select("__id", "__hash")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= MAX_BROADCAST else again
        left = left.unionByName(marked.join(again, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]))
    return left.select(*own.columns).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, each by its own text, whatever its doc_id; a null text is never contaminated."""
    own, _, text = numbered(docs)
    marked = own.withColumn("__digest", F.unhex(F.sha2(text, 256)))  # the verdict depends on the text alone
    found = decontaminate.contamination(marked, table(spark, sf_dir, "benchmark"), id_col="__digest", text_col=text)
    gone = stored(found.where(contaminated()).select("__digest").distinct(), "contaminated")
    return without(marked, gone, ["__digest"]).select(*own.columns).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the new text."""
    own, key, text = numbered(docs)
    rest = tuple(c for c in own.columns if c not in (key, text))
    found = pii.pii(own, pii.field_of(pii.labelled_table(spark)), key, text, keep=rest).withColumn(text, F.col("redacted"))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        found = found.withColumn(n, F.when(F.length("spans") > 0, F.length(text).cast(own.schema[n].dataType)).otherwise(F.col(n)))
    return found.select(*own.columns).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their digests, and those of the decoded bytes."""
    import public_tokenizers

    own, key, text = numbered(docs)
    encoded = bpe.bpe(own, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key, text)
    return encoded.select(F.col(key).alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
