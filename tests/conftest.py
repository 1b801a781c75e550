import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from metricledger import schemas  # noqa: E402
from metricledger.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 1, 10)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, app="tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_log(spark):
    """Log rows from dicts; what is not given takes a default."""

    def make(*rows: dict):
        full = []
        for i, row in enumerate(rows):
            ts = row.get("ts", BASE)
            base = {
                "query_id": i,
                "ts": ts,
                "query_param": "up",
                "time_param": ts,
                "duration_ms": 10,
                "status_code": 200,
                "body_size": 0,
                "fingerprint": "f",
                "label_matchers": [{"__name__": "up"}],
                "type": "instant",
                "step": None,
                "start_ts": ts,
                "end_ts": ts,
                "total_queryable_samples": 0,
                "peak_samples": 0,
                "http_headers": {},
                "dt": ts.date(),
            }
            base.update(row)
            names = base["label_matchers"]
            base["metric_names"] = None if names is None else [m.get("__name__") for m in names]
            full.append(base)
        schema = schemas.QUERY_LOG
        return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in full], schema)

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
