"""The driver contract, with and without the optional part."""

import ast
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from livetext.plans.queries import QUERIES

REPO = pathlib.Path(__file__).resolve().parents[1]


def test_every_core_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_the_optional_part(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"])))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())); print(len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, check=True)
    assert ast.literal_eval(said.stdout.splitlines()[0]) == sorted(QUERIES)
