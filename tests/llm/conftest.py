"""Workers import the library from this checkout, wherever tests are started."""

from __future__ import annotations

import os

import pytest

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def given(documents):
    return documents.toPandas().sort_values("doc_id").reset_index(drop=True)
