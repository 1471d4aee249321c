"""Default parameters of the operators and detectors.

Fixed values: the reference's own network and thresholds, which defaults
must equal for results to match it.
"""

INTERNAL_PREFIX = "192.168.109."
INTERNAL_CIDR = "192.168.109.0/24"
PERIOD_FACTOR = 1.5                    # high upload/download and exfiltration: test > 1.5 x baseline
EXTERNAL_FLOWS_THRESHOLD = 37          # total test flows to the internet
MAX_COUNTRIES = 5                      # distinct known countries per source
TRANSFER_COUNTRIES = ("CN", "RU")
TRANSFER_BYTES = 1_000_000             # uploaded bytes to the listed countries
C2_MIN_INCREASE = 250                  # % growth of flows to internal hosts
C2_MIN_BASELINE = 50                   # baseline flows to internal hosts
TOP_HOSTS = 10                         # hosts compared between periods
TOP_SERVERS = 5                        # busiest internal addresses
DNS_RATIO_RANGE = (0.41, 0.45)         # normal DNS up/down ratio
BURST_SECONDS = (80000, 90000)         # burst window, exclusive bounds
BURST_TOP = 30
SKIP_MINUTES = 500
LAST_SECONDS = 60
TOP_DESTINATIONS = 2
HISTOGRAM_BINS = 10

# Our own calibration (the reference judges these by eye); see FIXTURES.md section 3.
MIN_FANOUT = 4                         # normal hosts reach the 4 servers
DNS_C2_VOLUME = 1.25                   # DNS connections above 1.25 x the mean over hosts
DNS_EXFIL_VOLUME = 1.5                 # DNS upload above 1.5 x the mean over hosts
QUIC_MIN_RATIO = 1.0                   # UDP/443 up/down (normal ~0.1)
TCP_MIN_RATIO = 0.3                    # TCP up/down per source (normal ~0.12)
TCP_MIN_EDGE_RATIO = 1.0               # up/down of the responsible edge
