import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlab.schema import FLOW_COLUMNS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flowlab.session import get_spark
    s = get_spark(app="flowlab-tests", master="local[*]", shuffle_partitions=8)
    yield s


def make_flows(spark, rows):
    """rows: dicts with any subset of flow columns; the rest get defaults."""
    defaults = dict(flow_id=None, period="test", timestamp=0, src_ip="192.168.109.1",
                    dst_ip="192.168.109.224", proto="tcp", port=443, up_bytes=100, down_bytes=1000)
    full = []
    for i, r in enumerate(rows):
        d = dict(defaults, **r)
        if d["flow_id"] is None:
            d["flow_id"] = i
        full.append(tuple(d[c] for c in FLOW_COLUMNS))
    schema = ("flow_id bigint, period string, timestamp bigint, src_ip string, dst_ip string, "
              "proto string, port int, up_bytes bigint, down_bytes bigint")
    return spark.createDataFrame(full, schema)


@pytest.fixture
def flows_of(spark):
    return lambda rows: make_flows(spark, rows)
