"""Sources and sinks: flow scans, range tables, CSV and block-list output."""

from .flows import (derive_flows, derived_flow_files, events_path, flows_from_events, load_flows, read_flows, read_periods,
                    with_file_order, write_flows)
from .ranges import (
    FIXTURE_COUNTRY_BY_OCTET, derived_dns_cache, derived_range_files, derived_ranges, fixture_asn_ranges, fixture_dns_cache,
    fixture_geo_ranges, ranges_from_cidrs, read_asn, read_dns_cache, read_geo,
)
from .sinks import blocklist, detections, read_csv_result, write_blocklist, write_csv

__all__ = [
    "derive_flows", "derived_flow_files", "events_path", "flows_from_events", "load_flows", "read_flows", "read_periods", "with_file_order", "write_flows",
    "FIXTURE_COUNTRY_BY_OCTET", "derived_dns_cache", "read_dns_cache", "derived_range_files", "derived_ranges", "fixture_asn_ranges", "fixture_dns_cache", "fixture_geo_ranges",
    "ranges_from_cidrs", "read_asn", "read_geo",
    "blocklist", "detections", "read_csv_result", "write_blocklist", "write_csv",
]
