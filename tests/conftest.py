import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kestrel.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


COUNTRIES = ["India", "Germany", "USA", "Canada", "UK"]
CATEGORIES = ["Electronics", "Books", "Home"]


@pytest.fixture(scope="session")
def sales30(spark):
    """30 order rows built by rule."""
    import datetime as dt
    rows = []
    for i in range(30):
        q = i % 4 + 1
        price = 100.0 + (i % 7) * 10
        disc = [0.0, 0.05, 0.1][i % 3]
        rows.append((f"O{i + 1:04d}", (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(),
                     f"CUST{(i % 10) + 1:03d}", COUNTRIES[i % 5], CATEGORIES[i % 3], q, price, disc,
                     q * price * (1 - disc)))
    return spark.createDataFrame(rows, "order_id string, order_date string, customer_id string, country string, "
                                       "product_category string, quantity int, unit_price double, "
                                       "discount_pct double, revenue double")


@pytest.fixture(scope="session")
def ab200(spark):
    """100 control + 100 treatment rows."""
    import datetime as dt
    rows = []
    for variant, conv, rev, sess in (("control", 22, 95, 45), ("treatment", 35, 102, 49)):
        for i in range(100):
            rows.append((f"{variant[0]}{i}", variant, 1 if i < conv else 0, float(rev + i % 7), float(sess + i % 9),
                         (dt.date(2024, 2, 1) + dt.timedelta(days=i % 14)).isoformat()))
    return spark.createDataFrame(rows, "user_id string, variant string, conversion int, revenue double, "
                                       "session_duration double, order_date string")
