"""Every operator and detector runs on an empty flow frame without error."""

import pytest

from flowlab.operators import aggregates as D
from flowlab.operators import detectors as R
from flowlab.operators import joins as J
from flowlab.operators import quantiles as Q
from flowlab.operators import rangejoin as RJ
from flowlab.operators import setops as G
from flowlab.operators import sorts as S
from flowlab.operators import windows as E
from flowlab.sources import fixture_geo_ranges
from tests.conftest import make_flows


@pytest.fixture(scope="module")
def empty(spark):
    return make_flows(spark, [dict()]).where("false")


@pytest.mark.parametrize("fn", [
    R.rule_high_upload, R.rule_high_download, R.rule_external_connections, R.detect_exfiltration,
    R.exfiltration_bytes, R.detect_c2_growth, R.detect_botnet, R.botnet_peers, R.detect_dns_c2,
    R.detect_quic_exfil, R.detect_tcp_exfil, R.detect_dns_exfil, R.discover_servers, R.server_roles,
    R.burst_window, J.host_activity, J.top_hosts_compare, J.period_compare, D.host_profile,
    D.up443_histogram, D.upload_histogram_time, D.internal_peers, D.dst_up_with_sources,
    E.flow_gap, E.avg_flow_gap, S.peak_hour,
])
def test_flow_operators_on_empty(empty, fn):
    rows = fn(empty).collect()
    if fn in (R.rule_high_upload, R.rule_high_download):
        assert rows[0].detected is False
    elif fn is R.rule_external_connections:
        assert rows[0].external_flows == 0 and rows[0].detected is False
    elif fn is D.up443_histogram:
        assert [(r.lo, r.hi, r.n) for r in rows] == [(None, None, 0)] * 10
    else:
        assert rows == []


def test_country_operators_and_describe_on_empty(spark, empty):
    cc = RJ.geo_country(empty, fixture_geo_ranges(spark))
    for fn in (R.rule_many_countries, R.rule_country_transfer, R.detect_new_countries, G.new_countries):
        assert fn(cc).collect() == []
    assert D.country_count(cc).first().n_countries == 0
    stats = {r.stat: r.up_bytes for r in Q.describe(empty, ["up_bytes", "down_bytes"]).collect()}
    assert stats["count"] == 0.0 and stats["50%"] is None
    assert R.alerts(empty, fixture_geo_ranges(spark)).collect() == []
