"""The pipeline's stages against brute force, and what the package does without them."""

import hashlib
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_components

import corpus_pipeline
from palimpsest.llm import pii, quality, queries
from palimpsest.llm._io import stored
from palimpsest.llm._words import buffers

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Extra columns named like what the operators add.
CLASH = ("score", "spans", "redacted", "base", "component", "component_id", "n_hit", "items", "ids", "__text", "c0", "n_tokens")


def awkward(spark, rows):
    """Rows of (doc_id, text) with the columns of documents, and clashing ones before and after."""
    made = [("x", i, t, "en" if k % 2 else None, None, len(t or ""), *[str(k)] * len(CLASH[1:])) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "score string, doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH[1:])).repartition(2)


def near_rows(sf_item):
    base = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None), (1, None), (2, ""), (2, ""), (None, ""), (None, base + " end"), (None, base), (5, base), (5, base + " "), (5, base), (9, base + " tail"), (5, "another text altogether with words"),
        (6, "another text altogether with words"), (7, "short"), (7, "short"), (8, "Short"), (None, "lonely words of a null row"), (None, "lonely words of a null row"), (10, sf_item), (None, sf_item), (10, "clean words here"), (11, "mail to a.b@c.org now"), (None, "call 10.0.0.1"),
    ]


def listed(rows):
    return sorted(str((r["doc_id"], r["text"])) for r in rows)


@pytest.fixture(scope="module")
def item(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "byte_bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf), name))
        if stage is not corpus_pipeline.byte_bpe:
            assert seen[-1].columns == COLUMNS and seen[-1].dtypes == docs.dtypes
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    stay = sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)
    assert sorted(r["doc_id"] for r in seen[2].collect()) == stay
    assert 0 < seen[3].count() <= seen[2].count() == len(stay) and seen[4].count() == seen[3].count() == seen[5].count()
    assert seen[4].where("text rlike '[a-z0-9]@[a-z]'").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


def test_quality_stage(spark, sf, item):
    """Each row by its own text: the score of the text alone decides."""
    rows = near_rows(item) + [(20, "@@ ## $$ %% 00 11 " * 40), (None, "@@ ## $$ %% 00 11 " * 40)]
    docs = awkward(spark, rows)
    kept = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert kept.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = lambda t: model.probabilities(model.margins(1, *quality.indicators(*buffers(pa.array([t], pa.string())))))[0]
    assert listed(kept.collect()) == sorted(str(r) for r in rows if score(r[1]) >= 0.3)


def test_join_stage(spark, sf, item):
    rows = near_rows(item)
    docs = awkward(spark, rows)
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, sf)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    labels = {d: c for d, _, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)}
    plain = [(i, t) for i, t in rows if not (t or "").strip()]
    assert sorted(map(str, (r for r in got if not (r[1] or "").strip()))) == sorted(map(str, plain))  # without words: all stay
    groups = {}
    for k, (i, t) in enumerate(rows):
        if (t or "").strip():
            groups.setdefault(labels[k], []).append((i, t))
    worded = [r for r in got if (r[1] or "").strip()]
    assert len(worded) == len(groups)
    for members in groups.values():
        ids = [i for i, _ in members if i is not None]
        stays = [r for r in worded if r in members]
        assert len(stays) == 1 and stays[0][0] == (min(ids) if ids else None), members
    # two rows without words stay two, whatever else the table holds
    two = awkward(spark, [(1, ""), (1, "")])
    assert corpus_pipeline.ngram_jaccard_join(spark, two, sf).count() == 2
    assert corpus_pipeline.ngram_jaccard_join(spark, awkward(spark, [(1, ""), (1, ""), (4, "a b c d e f"), (4, "a b c d e f")]), sf).count() == 3


def test_decontamination_stage(spark, sf, item):
    rows = near_rows(item)
    kept = corpus_pipeline.benchmark_decontamination(spark, awkward(spark, rows), sf)
    assert listed(kept.collect()) == sorted(str(r) for r in rows if r[1] != item)


def test_personal_data_stage(spark, sf, item):
    rows = near_rows(item)
    docs = awkward(spark, rows)
    kept = corpus_pipeline.personal_data(spark, docs, sf)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    field = pii.train(pii.labelled_rows(900))
    want = []
    for i, t in rows:
        base, added = pii.find(pa.array([t], pa.string()), field)
        x = pii.redacted(t, base[0] + added[0]) if base[0] or added[0] else t
        want.append(str((i, x, len(x or ""))))
    assert sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in kept.collect()) == sorted(want)
    assert any("[EMAIL]" in w for w in want) and any("[IP]" in w for w in want)


def test_encoding_stage(spark, sf, item):
    from test_operators import tokenizer

    rows, theirs = near_rows(item), tokenizer()[2]
    got = corpus_pipeline.byte_bpe(spark, awkward(spark, rows), sf).collect()
    want = []
    for i, t in rows:
        ids = np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes()
        want.append(str((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got) == sorted(want)


def test_empty_tables(spark, sf, item):
    docs = awkward(spark, near_rows(item)).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_decontamination_by_row(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    rows = [(None, item), (1, item), (1, "clean words of another text"), (2, "clean"), (None, "clean"), (3, None), (None, None), (4, item), (2, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, sf)
    assert kept.columns == COLUMNS
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(str(r) for r in rows if r[1] != item)


def test_queries_registered():
    names = list(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))


def test_rest_works_without(tmp_path):
    """Without this subpackage, its tests and the pipeline, the rest imports and a query of it agrees with its SQL."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run(f"cp -r {root}/palimpsest {root}/tests {root}/__spark_entry__.py {root}/bench.py {tmp_path} && rm -r {tmp_path}/palimpsest/llm {tmp_path}/tests/llm", shell=True, check=True)
    libraries = [p for p in dict.fromkeys([*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sys.path]) if p and os.path.realpath(p) != os.path.realpath(root) and not os.path.realpath(p).startswith(os.path.realpath(root) + os.sep)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *libraries])}
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "s1_scan_by_agent or a4_stage_counts"], cwd=tmp_path, env=env, check=True)
    # the pipeline alone does not bring them back, and is no error
    subprocess.run(f"cp {root}/corpus_pipeline.py {tmp_path}", shell=True, check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
