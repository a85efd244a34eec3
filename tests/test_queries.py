"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import glob
import os
import re
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docproof.operators import checks, evidence, repair
from docproof.plans.queries import ORACLES, QUERIES
from docproof.sources.tables import load


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(x):
    if x is None or (not isinstance(x, (list, tuple, np.ndarray)) and pd.isna(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([cell(y) for y in x])
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    try:
        return round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(zip(*[[cell(x) for x in frame[c]] for c in frame.columns], strict=True), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_words_round_trip(spark, sf_dir):
    assert QUERIES["SC19_words_round_trip"](spark, sf_dir).where("back is null or abs(back - amount) > 0.001").isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4 and set(e.oracle_sql()) <= set(e.queries())


def test_whole_int_by_hand(spark, sf_dir):
    fold = str.maketrans("०१२३४५६७८९", "0123456789")

    def by_hand(x):
        if x == "nil":
            return 0
        x = x.translate(fold)
        minus = x.startswith(("(", "-")) or False
        digits = re.sub(r"₹|Rs\.|INR|/-|only|[(), ]|^-|-$", "", x)
        if not re.fullmatch(r"\d+(\.\d+)?|\.\d+", digits) or Decimal(digits) % 1:
            return None
        return -int(Decimal(digits)) if minus else int(Decimal(digits))

    got = QUERIES["SC3_parse_int"](spark, sf_dir).collect()
    assert len(got) == load(spark, sf_dir, "prints").count()
    assert not [(r["amount"], r["n"]) for r in got if r["n"] != by_hand(r["amount"])]
