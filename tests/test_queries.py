"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from netloom import registry

SF = "/root/testdata/sf0.001"
NAMES = [
    "graph_from_vec", "load_json", "add_edge", "shuffle_adjs", "sw_rewire_edge", "get_vertices", "degree_histogram", "bfs_filtered", "connected_components", "q_core",
    "vertex_load", "closeness_centrality", "cloned_subgraph", "er_c", "er_m", "spatial", "dog", "latin_hypercube_2d", "config_model", "undo_config", "dual_degree", "dual_bfs_index", "dot_from_contained", "save_json", "transitivity_dense",
    "dfs_order", "dfs_mut", "bfs_index_depth_mut", "vertex_biconnected_components", "metropolis", "metropolis_while", "m_step_er_c", "simple_sample", "dual_dfs_contained", "er_m_dense", "load_fields", "resume", "to_dot_with_labels", "dog_dot", "transitivity",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    assert sorted(map(tuple, frame.select(columns).collect()), key=str) == want


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() == 1


def test_entry_without_a_package_of_the_other_subpackage(tmp_path):
    """Whatever llm misses, the graph queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-1]) == len(registry.queries()) and "left out" in said.stderr


def test_entry_without_the_other_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "netloom", tmp_path / "netloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-1]) == len(registry.queries())
