"""Fixtures of the subpackage's tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import awkward, make  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [(1, "x")]).where("false")
