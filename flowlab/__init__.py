"""flowlab: network-flow analytics and anomaly detection on Spark.

    from flowlab import get_spark, read_periods, detectors
    spark = get_spark()
    flows = read_periods(spark, baseline_path, test_path)
    detectors.detect_exfiltration(flows).show()
"""

from .operators import aggregates, detectors, filters, joins, rangejoin, setops, sorts, windows
from .session import get_spark
from .sources import load_flows, read_asn, read_flows, read_geo, read_periods

__all__ = ["get_spark", "load_flows", "read_flows", "read_periods", "read_geo", "read_asn",
           "aggregates", "detectors", "filters", "joins", "rangejoin", "setops", "sorts", "windows"]
