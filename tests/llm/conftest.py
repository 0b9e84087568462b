"""The rows shared by the tests of the text operators."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import data  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    return data.hard(spark)


@pytest.fixture(scope="session")
def clashing(spark):
    return data.clashing(spark)


@pytest.fixture(scope="session")
def none(spark):
    return data.empty(spark)
