"""The registered queries, the pipeline against brute force, and life without this package."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from compare import connect, difference, schema_difference
from starlens.llm import queries, tokens
from test_nearcopies import groups as near_groups

SQL = queries.oracle_sql()
COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_simhash_near_duplicates": ["doc_id", "fingerprint", "component_id"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_ordinal_toxicity": ["doc_id", "severity"],
    "op12_repeated_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op9_order_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def test_all_of_them_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con, df = connect(sf_dir), queries.QUERIES[name](spark, sf_dir)
    assert schema_difference(df, con, SQL[name]) is None
    assert difference(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_for_every_document(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    ids = {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_poisson_mixing", "op13_benchmark_decontamination"])
def test_native_plans_run_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage's rows from those of the stage before, by plain code."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34", "en", "src1", 5), (9004, "Привет, мир", None, "src2", 11)]
    copy = source.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 5000)
    source.unionByName(copy).unionByName(spark.createDataFrame(extra, source.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [sorted(map(tuple, docs.collect()), key=str)]
    stages = dict(corpus_pipeline.STAGES)
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, current, str(tmp_path)).write.parquet(out)
        current = spark.read.parquet(out)
        if k < len(stages) - 1:
            assert current.columns == corpus_pipeline.COLUMNS
            seen.append(sorted(map(tuple, current.collect()), key=str))
    given, known, single, cleaned, mixed = seen

    # rejected are the texts without letters or in no known script
    assert {r[0] for r in given} - {r[0] for r in known} == {9001, 9002, 9003, 9004}
    # one document, with the smallest id, of each group
    want = set(near_groups([(r[0], r[1]) for r in known]).values())
    assert {r[0] for r in single} == want and len(single) == len(want) and set(single) <= set(known)
    # no repeated string is left
    rest = {i: kept.decode("utf-8", "ignore") for i, *_, kept in brute.removed([(r[0], r[1]) for r in single])}
    assert {r[0]: r[1] for r in cleaned} == rest and all(r[4] == len(r[1]) for r in cleaned)
    # copies by inverted draws
    size = {}
    for r in cleaned:
        size[r[3]] = size.get(r[3], 0) + len(r[1].encode())
    scale = sum(size.values()) / sum(b ** 0.7 for b in size.values())
    copies = [r for r in cleaned for _ in range(brute.poisson(r[0], scale * size[r[3]] ** 0.7 / size[r[3]]))]
    assert sorted(copies, key=str) == mixed
    # every copy is packed whole
    encoder = tokens.encoder(tokens.default_path())
    rows = current.collect()
    assert sum(r["length"] for r in rows) == sum(len(encoder.tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in copies)
    room = {}
    for r in rows:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 1024 and sum(r["piece"] == 0 for r in rows) == len(copies)


def test_the_rest_works_without_this_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "starlens"), tmp_path / "starlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'overview' in q and 'pipeline' not in q and len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
