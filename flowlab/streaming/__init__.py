"""Structured Streaming versions of the per-host detector aggregates."""

from .blocklist import live_blocklist, merge_batch, read_blocklist
from .live import (baseline_contact_rate, baseline_profile, flag_contact_growth, flag_windows,
                   live_c2_growth, live_exfiltration, live_fanout, read_flow_stream,
                   windowed_fanout, windowed_host_rates, windowed_internal_contacts, with_event_time)

__all__ = ["baseline_contact_rate", "baseline_profile", "flag_contact_growth", "flag_windows",
           "live_blocklist", "live_c2_growth", "live_exfiltration", "live_fanout", "merge_batch", "read_blocklist",
           "read_flow_stream",
           "windowed_fanout", "windowed_host_rates", "windowed_internal_contacts", "with_event_time"]
