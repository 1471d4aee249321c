"""Detector defaults reproduce the calibration table of FIXTURES.md section 3 (sf0.01)."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
Q = entry.queries()
H = "192.168.109."


def rows(spark, key):
    return [r.asDict() for r in Q[key](spark, SF).collect()]


def hosts(spark, key, col="src_ip"):
    return sorted(r[col] for r in rows(spark, key))


@pytest.mark.parametrize("key,expected", [
    ("detect_exfiltration", [H + "15", H + "6", H + "8"]),
    ("detect_botnet", [H + "12", H + "18", H + "4"]),
    ("detect_dns_c2", [H + "8"]),
    ("detect_quic_exfil", [H + "15", H + "6"]),
    ("detect_dns_exfil", [H + "10"]),
    ("rule_many_countries", [H + "14"]),
    ("rule_country_transfer", [H + "15"]),
])
def test_flagged_hosts(spark, key, expected):
    assert hosts(spark, key) == expected


def test_numbers(spark):
    c2 = rows(spark, "detect_c2_growth")
    assert [(r["src_ip"], r["counts"], r["counts_test"]) for r in c2] == [(H + "8", 77, 345)]
    assert round(c2[0]["increase"]) == 348
    assert rows(spark, "rule_external_connections")[0] == {"external_flows": 1281, "detected": True}
    assert rows(spark, "rule_high_upload")[0]["detected"] is True
    assert rows(spark, "rule_high_download")[0]["detected"] is False
    assert rows(spark, "rule_many_countries")[0]["n_countries"] == 11
    assert rows(spark, "rule_country_transfer")[0]["up_bytes"] == 2_559_700
    assert rows(spark, "detect_dns_c2")[0]["conns"] == 154
    assert len(rows(spark, "detect_tcp_exfil")) == 50
    assert sorted(r["dst_cc"] for r in rows(spark, "new_countries")) == ["", "BR", "CN", "ES", "FR", "NL", "RU", "SE"]
    assert len(rows(spark, "burst_window")) == 30
    assert hosts(spark, "discover_servers", "ip")[1:] == [H + "224", H + "225", H + "227", H + "230"] or \
        set(hosts(spark, "discover_servers", "ip")) >= {H + "224", H + "225", H + "227", H + "230"}
    assert rows(spark, "port53_non_udp")[0]["violations"] == 0
    assert rows(spark, "port443_non_udp")[0]["violations"] == 5750


def test_server_roles_from_ports(spark):
    roles = {r["ip"]: r["services"] for r in rows(spark, "server_roles")}
    assert roles[H + "224"] == roles[H + "227"] == "udp/53"
    assert roles[H + "225"] == roles[H + "230"] == "tcp/443"
