"""IP range tables (A3, A4) and the reverse-DNS cache used by J10.

The range tables replace the binary country and organisation databases: one
row per disjoint, inclusive integer range ``[lo, hi]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_to_num, ptr_name
from ..schema import ASN_SCHEMA, DNS_CACHE_SCHEMA, GEO_SCHEMA

# The test fixture's country per first octet, each a whole /8.
# Octet 27 is deliberately absent (unknown country).
FIXTURE_COUNTRY_BY_OCTET = {
    20: "US", 21: "PT", 22: "GB", 23: "DE", 24: "NL", 25: "FR",
    26: "ES", 28: "SE", 29: "BR", 30: "CN", 31: "RU",
}


def _read_table(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "csv":
        # '\N' marks null so that '', null and 'NA' all survive (section 1.5).
        return (spark.read.schema(schema).option("header", True)
                .option("nullValue", "\\N").csv(path))
    raise ValueError(f"unsupported range table format {fmt!r}")


def read_geo(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A3: ``(lo, hi, cc)`` country ranges."""
    return _read_table(spark, path, GEO_SCHEMA, fmt)


def read_asn(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: ``(lo, hi, org)`` organisation ranges."""
    return _read_table(spark, path, ASN_SCHEMA, fmt)


def read_dns_cache(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """J10's lookup table ``(ptr_name, host)``; a null host is a name known to have none."""
    return _read_table(spark, path, DNS_CACHE_SCHEMA, fmt)


def derived_dns_cache(spark: SparkSession, sf_dir: str) -> str:
    """Path of a stored, partial PTR cache around a scale factor's destinations,
    written once apart from the flows: half of them by first octet, some of those
    without a host, a few names twice."""
    from .store import flows_table_path, read_flow_table, table_path
    source = flows_table_path(spark, sf_dir)

    def write(path: str) -> None:
        cache = fixture_dns_cache(read_flow_table(spark, source))
        octets = F.split(F.col("ptr_name"), r"\.")
        nameless = cache.withColumn("host", F.when(F.element_at(octets, 2).cast("int") % 5 != 3, F.col("host")))
        again = nameless.where(F.element_at(octets, 1).cast("int") == 1).withColumn("host", F.concat(F.lit("z-"), F.col("host")))
        nameless.unionByName(again).write.parquet(path)

    return table_path(spark, "ptr", source, write)


def fixture_geo_ranges(spark: SparkSession) -> DataFrame:
    rows = [(o << 24, ((o + 1) << 24) - 1, cc) for o, cc in sorted(FIXTURE_COUNTRY_BY_OCTET.items())]
    return spark.createDataFrame(rows, GEO_SCHEMA)


def fixture_asn_ranges(spark: SparkSession) -> DataFrame:
    rows = [(o << 24, ((o + 1) << 24) - 1, f"AS{o} ORG{o}") for o in sorted(FIXTURE_COUNTRY_BY_OCTET)]
    return spark.createDataFrame(rows, ASN_SCHEMA)


def derived_ranges(flows: DataFrame) -> DataFrame:
    """``(lo, hi, cc, org)``: nested ranges around the external destinations of the
    flows: /8 blocks of the fixture's countries, and inside them (or alone) /22
    and /24 blocks, unaligned pairs of addresses and single addresses, chosen by
    the address's octets."""
    from ..functions.net import outside_cidr
    num = F.col("dst_ip_num")
    dst = flows.where(outside_cidr(num) & num.isNotNull()).select(num.alias("n")).distinct()
    a, b, c, d = (F.shiftright("n", s) % 256 for s in (24, 16, 8, 0))
    n24 = F.col("n") - d
    country = F.element_at(F.create_map(*[F.lit(x) for kv in FIXTURE_COUNTRY_BY_OCTET.items() for x in kv]), a.cast("int"))

    def span(chosen, lo, size: int, cc, tag: str):
        return F.when(chosen, F.struct(lo.alias("lo"), (lo + (size - 1)).alias("hi"), cc.alias("cc"),
                                       F.concat(F.lit(f"{tag} "), a.cast("string")).alias("org")))

    spans = F.array(span(country.isNotNull(), F.col("n") - F.col("n") % (1 << 24), 1 << 24, country, "BLOCK"),
                    span((a + b) % 3 == 0, F.col("n") - F.col("n") % (1 << 16), 1 << 10, F.lit("CA"), "REGION"),
                    span((a + b + c) % 4 == 1, n24, 1 << 8, F.lit("CH"), "SITE"),
                    span((a + 2 * b + c) % 5 == 2, n24 + 1, 2, F.lit("IT"), "PAIR"),
                    span((a + b + c + d) % 7 == 0, F.col("n"), 1, F.lit("NO"), "HOST"))
    return dst.select(F.explode(F.array_compact(spans)).alias("s")).select("s.*").distinct()


def derived_range_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of the country and the organisation range table derived from a scale
    factor's flows, written once as Parquet beside the stored flow table."""
    from .store import flows_table_path, read_flow_table, table_path
    source = flows_table_path(spark, sf_dir)

    def write(column: str):
        return lambda path: derived_ranges(read_flow_table(spark, source)).select("lo", "hi", column).write.parquet(path)

    return table_path(spark, "geo", source, write("cc")), table_path(spark, "asn", source, write("org"))


def ranges_from_cidrs(spark: SparkSession, entries, value_col: str = "cc") -> DataFrame:
    """Build a range table from ``(cidr, value)`` pairs (tests, small configs)."""
    from ..functions.net import cidr_bounds
    schema = GEO_SCHEMA if value_col == "cc" else ASN_SCHEMA
    return spark.createDataFrame([(*cidr_bounds(c), v) for c, v in entries], schema)


def fixture_dns_cache(flows: DataFrame) -> DataFrame:
    """A partial PTR cache derived from the flows' own destinations.

    Stands in for live reverse lookups: every destination with an even first
    octet has an entry ``h<a>-<b>-<c>-<d>.example``; the others miss, so the
    left join in J10 sees both cases.
    """
    dst = flows.select("dst_ip").distinct()
    num = ip_to_num("dst_ip")
    return (dst.where(F.shiftright(num, 24) % 2 == 0)
            .select(ptr_name("dst_ip").alias("ptr_name"),
                    F.concat(F.lit("h"), F.regexp_replace("dst_ip", r"\.", "-"), F.lit(".example")).alias("host"))
            .select([F.col(f.name).cast(f.dataType) for f in DNS_CACHE_SCHEMA.fields]))
