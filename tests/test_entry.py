"""The contract holds without the optional subpackage and the packages that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "skyledger.llm", "skyledger.llm.queries", "corpus_pipeline"])
def test_core_without(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as contract
names = set(contract.queries())
assert "mart_route_daily" in names and set(contract.oracle_sql()) <= names
assert {missing!r} == "corpus_pipeline" or not any(n.startswith("op") for n in names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
