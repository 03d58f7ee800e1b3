from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: A few queries of each family against their SQL; all of them are compared at a larger scale by the driver.
COMPARED = (
    "dense_ir_metrics", "bm25_ir_metrics", "group_split", "classification_metrics", "confusion_matrix", "calibration_ece_brier_nll", "holm_adjust", "mixture_sample", "audit_sample_disjoint", "latency_percentiles", "violations_id_sets", "random_negatives",
    "strict_output_parse", "strict_decision_parse", "token_budget_evidence", "grouped_kfold", "comparison_family", "violations_pools", "training_audit", "claim_groups", "best_rationale_choice",
    "shared_kfold", "walked_negatives", "rationale_pairs", "gold_rationales", "target_json", "table_digest", "checks_in_one_scan", "file_pins", "annotated_coverage",
)


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([round(float(x), 6) if isinstance(x, float | np.floating) else (list(x) if isinstance(x, np.ndarray) else x) for x in row]) for row in frame.astype(object).itertuples(index=False, name=None))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_coverage_is_that_of_both_rankings():
    made = {**__spark_entry__.oracle_sql()}
    assert "eligible" in made["annotated_coverage"] and "covered" in made["covered_queries"]
    with pytest.raises(ValueError, match="two queries"):
        __spark_entry__.catalogue._query("SELECT 1")(__spark_entry__.queries()["annotated_coverage"])


@pytest.mark.parametrize("name", ["covered_queries", "rerank_changes"])
def test_more_queries_as_sql(spark, name):
    test_query_as_sql(spark, name)


@pytest.mark.parametrize("name", COMPARED)
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    made = __spark_entry__.queries()[name](spark, SF).toPandas()
    wanted = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert plain(made) == plain(wanted)


@pytest.mark.parametrize("name", ["hard_negatives", "paired_training_rows", "training_audit"])
def test_queries_with_few_negatives_as_sql(spark, tmp_path, name):
    """Thirty copies of every vector: the first fifty of a query are copies and positives, and few negatives are left."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT vec_id + 100000 * k AS vec_id, embedding, label FROM read_parquet('{SF}/embeddings.parquet'), (SELECT unnest(range(30)) AS k) WHERE vec_id < 120) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    wanted = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert plain(__spark_entry__.queries()[name](spark, str(tmp_path)).toPandas()) == plain(wanted)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_the_rest_works_without_the_subpackage(tmp_path):
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{here}/lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_topk' in q and not any(k.startswith('op') for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
