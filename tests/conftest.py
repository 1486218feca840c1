import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rillstone.session import build_session  # noqa: E402

# date, month, kind, item, amount
PROFITS = """05-05-2021,May,Garden,Rake,17
06-05-2021,May,Kitchen,Kettle,9
02-09-2021,September,Garden,Hose,31
09-05-2021,May,Office,Lamp,44
11-05-2021,May,Garden,Spade,26
03-09-2021,September,Office,Desk,58
15-05-2021,May,Kitchen,Pan,9
21-09-2021,September,Kitchen,Cup,12
17-05-2021,May,Office,Chair,44
04-11-2021,November,Garden,Seeds,23
22-05-2021,May,Office,Stapler,13
27-09-2021,September,Garden,Gloves,12""".splitlines()

TRANSACTIONS = """TXN901,33500,USD,Oslo,Bergen,1700000100123
TXN902,64000,INR,Pune,Nagpur,1700000200456
TXN903,2300,USD,Oslo,Oslo,1700000300789
TXN904,87000,EUR,Lyon,Porto,1700000400012""".splitlines()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def profits(spark):
    from rillstone.operators.parsing import pick

    layout = {"month": (1, "string"), "category": (2, "string"), "product": (3, "string"), "profit": (4, "int")}
    lines = spark.createDataFrame(list(enumerate(PROFITS)), "seq bigint, line string")
    return pick(lines, "line", layout)


@pytest.fixture
def transactions(spark):
    from rillstone.operators.parsing import parse

    return parse(spark.createDataFrame([(t,) for t in TRANSACTIONS], "line string"), "line")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
