"""The rest of the package neither needs nor imports the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def copied(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py", "spark-warehouse"))
    return copy


def test_other_tests_pass_without_it(tmp_path):
    copy = copied(tmp_path)
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_language.py", "tests/test_predicates.py"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_entry_without_the_subpackage(tmp_path):
    copy = copied(tmp_path)
    code = "import __spark_entry__ as e, sys; n = list(e.queries()); assert 'scan_project' in n and not any(x.startswith('op') or x == 'pipeline' for x in n); assert set(e.oracle_sql()) == set(n); assert not any('llm' in m for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "nestql")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"nestql\.llm|from \.+llm", f.read()), name
