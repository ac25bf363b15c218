import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidepanel.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", 8, partitions=8)


@pytest.fixture(scope="session")
def sf():
    return SF


def walk(symbol: str, n: int, seed: int) -> pd.DataFrame:
    """Random-walk bars on calendar days."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.012, n)))
    open_ = close * (1 + rng.normal(0, 0.003, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.004, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.004, n)))
    ts = pd.date_range("2020-01-01", periods=n, freq="D")
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low, "close": close,
                         "volume": rng.integers(1, 1000, n).astype(float)})


SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def panel_pdf():
    """One long, one medium, one short symbol, and one with constant prices."""
    flat = walk("FLAT", 120, 4).assign(open=50.0, high=50.0, low=50.0, close=50.0)
    return pd.concat([walk("LONG", 700, 1), walk("MID", 320, 2), walk("SHORT", 15, 3), flat], ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf, SCHEMA).cache()
