import datetime as dt
import random

import pytest
from pyspark.sql import SparkSession

from tallyframe import compare

#: Two stocktakes of a depot: name, type, and which of the two has the column.
STOCK = {"crate": "long", "goods": "string", "bay": "string", "kilos": "double", "sealed": "boolean", "packed": "date", "pieces": "int"}
SPRING, AUTUMN = "clerk", "scanner"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


def stocktakes(seed=21, crates=60):
    """Rows of both stocktakes as dicts, in order: some crates are only in one, some values differ, some are missing."""
    dice = random.Random(seed)
    goods = ["Oats", "oat MEAL", "rye", "Spelt ", "", "Grünkern", "barley 40"]
    spring, autumn = [], []
    for crate in range(100, 100 + crates):
        row = {
            "crate": crate,
            "goods": dice.choice(goods),
            "bay": dice.choice(["N1", "N2", "S7", None]),
            "kilos": dice.choice([12.5, 40.0, 55.25, float("nan"), None]),
            "sealed": dice.choice([True, False, None]),
            "packed": dt.date(2023, 11, 1) + dt.timedelta(days=dice.randrange(40)),
            "pieces": dice.choice([None, *range(5)]),
        }
        later = dict(row)
        for column in ("goods", "bay", "kilos", "sealed", "packed", "pieces"):
            if dice.random() < 0.12:
                later[column] = {"goods": "millet", "bay": "W3", "kilos": 41.5, "sealed": dice.choice([True, False]), "packed": dt.date(2024, 2, 29), "pieces": 9}[column]
        if crate % 9 != 4:
            spring.append(row | {SPRING: dice.choice(["Ida", "Noor", None])})
        if crate % 11 != 6:
            autumn.append(later | {AUTUMN: dice.choice(["A", "b", None])})
    return spring, autumn


def table(spark, rows, extra):
    schema = ", ".join(f"{c} {t}" for c, t in (STOCK | {extra: "string"}).items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)


@pytest.fixture(scope="session")
def stock():
    return stocktakes()


@pytest.fixture(scope="session")
def left(spark, stock):
    return table(spark, stock[0], SPRING)


@pytest.fixture(scope="session")
def right(spark, stock):
    return table(spark, stock[1], AUTUMN)


@pytest.fixture(scope="session")
def result(left, right):
    return compare(left, right, "crate")


class Row:
    """A row of the comparison as plain Python has it: either side as a dict or None."""

    def __init__(self, before, after):
        self.before, self.after = before, after
        self.key = (before or after)["crate"]
        same = lambda a, b: a == b or (_none(a) and _none(b))
        self.differing = [c for c in STOCK if c != "crate" and before and after and not same(before[c], after[c])]
        self.status = "missing_right" if not after else "missing_left" if not before else "mismatch" if self.differing else "equal"

    def values(self, column):
        """What a filter of the column sees: the key, or both sides' values; NaN is None."""
        if column == "crate":
            return [self.key]
        return [None if _none(side[column]) else side[column] for side in (self.before, self.after) if side and column in side]


def _none(value):
    return value is None or value != value


@pytest.fixture(scope="session")
def expected(stock):
    """The comparison's rows in order: those of spring, then those that only autumn has."""
    spring, autumn = ({r["crate"]: r for r in side} for side in stock)
    return [Row(r, autumn.get(k)) for k, r in spring.items()] + [Row(None, r) for k, r in autumn.items() if k not in spring]
