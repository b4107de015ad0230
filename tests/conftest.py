from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from claimscope.sources import schemas  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from claimscope.session import RUNTIME_CONF

    # Warehouse and scratch tables of the run; on a cluster spark.checkpoint.dir names a shared folder.
    scratch = tmp_path_factory.mktemp("claimscope")
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("claimscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(scratch / "shared"))
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


def claim(billing, code, month, claims=20, benes=5, paid="100.00", state="S1", servicing=None):
    year = month[:4] if month is not None else None
    return (billing, servicing, code, month, claims, benes, Decimal(paid), state, year)


def reg(npi, entity_type="2", org=None, first=None, last=None, state="S1", city="C", credentials=None,
        taxonomy=None):
    return (npi, entity_type, org, first, last, credentials, taxonomy, "1 Main", city, state, "00001", "555-0001")


@pytest.fixture
def make(spark):
    """Build tiny model tables from tuples."""

    class Make:
        @staticmethod
        def claims(rows):
            return spark.createDataFrame(rows, schemas.CLAIMS)

        @staticmethod
        def ref(rows):
            return spark.createDataFrame(rows, schemas.CODE_REFERENCE)

        @staticmethod
        def registry(rows):
            return spark.createDataFrame(rows, schemas.REGISTRY)

    return Make
