"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._io import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.substring import dedup

    out = dedup(table(spark, sf_dir, "documents"), n=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"), n=3, percent=90).drop("component")


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.url_lists import captures_of, entries_of, evaluate

    pages = table(spark, sf_dir, "pages")
    return evaluate(captures_of(pages), entries_of(pages)).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.warc import lookup, write

    pages = table(spark, sf_dir, "pages")
    folder, directory = write(pages)
    return lookup(folder, directory, pages, payload=False).drop("payload")


THRESHOLD = 0.3  # of the quality score


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palimpsest.llm.bpe import bpe, digests

    return digests(bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.pii import field_of, labelled_table, pii

    found = pii(table(spark, sf_dir, "documents"), field_of(labelled_table(spark)))
    of = lambda k: F.size(F.regexp_extract_all("base", F.lit(f"(?:^|,){k}:"), 0)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of, ("email", "ip", "card", "phone")), F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    number = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", number("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(), number("near").alias("n_near"))


def contaminated():
    return ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.html_text import labelled_table, main_text, weights_of

    found = main_text(table(spark, sf_dir, "pages"), weights_of(labelled_table(spark)))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.variants import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.languages import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs), switches=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palimpsest.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from palimpsest.llm.oracles import SQL

    return dict(SQL)
