import os
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartlens.schema import CLICKSTREAM  # noqa: E402
from cartlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "cartlens-tests",
        master="local[8]",
        shuffle_partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        # Small shuffles stay in several partitions, so that partition borders are tested.
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from ``(time, type, product, category, price, user, session)`` tuples."""

    def make(rows):
        full = [
            (i, time, kind, product, 1, category, "brand", float(price), user, session)
            for i, (time, kind, product, category, price, user, session) in enumerate(rows)
        ]
        return spark.createDataFrame(full, CLICKSTREAM)

    return make


@pytest.fixture(scope="session")
def random_events(make_events):
    """400 seeded events; user 1 and session s0 hold about a third of them."""
    rng = np.random.default_rng(7)
    start = datetime(2024, 1, 1, 12)
    rows = []
    for i in range(400):
        user = 1 if rng.random() < 0.33 else int(rng.integers(2, 20))
        session = "s0" if rng.random() < 0.33 else f"s{rng.integers(1, 40)}"
        rows.append(
            (
                start + timedelta(minutes=int(rng.integers(0, 60 * 24 * 20))),
                str(rng.choice(["view", "cart", "purchase"])),
                int(rng.integers(1, 30)),
                str(rng.choice(["electronics.phone", "apparel.shoes.red", "home", "toys.x"])),
                round(float(rng.uniform(10, 1000)), 2),
                user,
                session,
            )
        )
    return make_events(rows)
