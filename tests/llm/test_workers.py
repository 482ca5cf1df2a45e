"""Operators in a process whose Python workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tidemark.session import build_session
spark = build_session("workers", "local[2]", 2)
spark.sparkContext.setCheckpointDir({folder!r})

def missing(_):
    try:
        import tidemark
    except ImportError:
        return [1]
    return [0]

assert spark.sparkContext.parallelize([0], 1).flatMap(missing).collect() == [1]
from tidemark.llm import registry
registry.load()
for name in {names!r}:
    assert registry.QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_queries_where_workers_lack_the_package(tmp_path, sf_dir):
    repo = str(Path(__file__).resolve().parents[2])
    names = ["op2_secrets", "op3_lattice", "op9_decontaminate", "op11_merkle", "op12_personal", "op13_alignment"]
    code = SCRIPT.format(repo=repo, folder=str(tmp_path / "shared"), names=names, sf=sf_dir)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONSAFEPATH": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "all ran" in done.stdout, done.stderr[-3000:]
