"""Network analytics over connections. Aggregates combine before the shuffle; top lists end in TakeOrdered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake import refdata
from wirelake.functions import scalars as S
from wirelake.operators.common import top, total_bytes


def network_kpis(conn: DataFrame, approximate: bool = False) -> DataFrame:
    """Flows, bytes, different pairs, external flows and encrypted share in percent.

    approximate: counts pairs by a sketch, for tables where the exact distinct count is too wide.
    """
    pair = F.concat(F.coalesce("src_ip", F.lit("")), F.lit("->"), F.coalesce("dst_ip", F.lit("")))
    sums = [
        F.count(F.lit(1)).alias("total_flows"),
        F.coalesce(F.sum(total_bytes()), F.lit(0)).alias("total_bytes"),
        F.count_if(S.is_external_like(F.col("dst_ip"))).alias("external_flows"),
        F.count_if(F.lower(F.coalesce("protocol", F.lit(""))).isin("ssl", "tls")).alias("encrypted_flows"),
    ]
    if approximate:
        out = conn.agg(*sums, F.approx_count_distinct(pair, 0.01).alias("unique_pairs"))
    else:  # two plain aggregations instead of one expanded for the distinct count
        pairs = conn.select(pair.alias("pair")).distinct().agg(F.count(F.lit(1)).alias("unique_pairs"))
        out = conn.agg(*sums).crossJoin(F.broadcast(pairs))  # one row each
    share = F.when(F.col("total_flows") > 0, F.round(100.0 * F.col("encrypted_flows") / F.col("total_flows"), 1)).otherwise(0.0)
    return out.select("total_flows", "total_bytes", "unique_pairs", "external_flows", "encrypted_flows", share.alias("encrypted_pct"))


def top_talkers_outbound(conn: DataFrame, n: int = 10) -> DataFrame:
    """Per source: bytes, connections, different destinations; the largest by bytes."""
    by_pair = conn.groupBy("src_ip", "dst_ip").agg(F.sum(total_bytes()).alias("bytes"), F.count(F.lit(1)).alias("connections"))
    out = by_pair.groupBy("src_ip").agg(F.sum("bytes").alias("bytes"), F.sum("connections").alias("connections"), F.count("dst_ip").alias("destinations"))
    return top(out, n, "bytes", "src_ip")


def top_talkers_lateral(conn: DataFrame, n: int = 10) -> DataFrame:
    """Per source inside 10/8 talking inside 10/8, by connections."""
    inside = conn.filter(F.col("src_ip").like("10.%") & F.col("dst_ip").like("10.%"))
    by_pair = inside.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("connections"), F.sum(total_bytes()).alias("bytes"))
    out = by_pair.groupBy("src_ip").agg(F.sum("connections").alias("connections"), F.sum("bytes").alias("bytes"), F.count("dst_ip").alias("destinations"))
    return top(out, n, "connections", "src_ip")


def protocol_stats(conn: DataFrame, n: int = 10) -> DataFrame:
    out = conn.groupBy(F.lower(F.coalesce("protocol", F.lit("unknown"))).alias("protocol")).agg(F.count(F.lit(1)).alias("connections"), F.sum(total_bytes()).alias("bytes"))
    return top(out, n, "connections", "protocol")


def protocol_trends(conn: DataFrame, n: int = 300) -> DataFrame:
    """Hour of day by protocol, by hour, then largest first."""
    out = conn.groupBy(S.hour_of(F.col("event_time")).alias("hour"), F.lower(F.coalesce("protocol", F.lit("unknown"))).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy("hour", F.desc("n"), "protocol").limit(n)


def services(conn: DataFrame, n: int = 20) -> DataFrame:
    """Destination port by protocol: connections, different sources, bytes."""
    by_source = conn.groupBy("dst_port", "protocol", "src_ip").agg(F.count(F.lit(1)).alias("connections"), F.sum(total_bytes()).alias("bytes"))
    out = by_source.groupBy("dst_port", "protocol").agg(F.sum("connections").alias("connections"), F.count("src_ip").alias("sources"), F.sum("bytes").alias("bytes"))
    return top(out, n, "connections", "dst_port", "protocol")


def unusual_external(conn: DataFrame, n: int = 10) -> DataFrame:
    """External destinations by bytes, with the number of all of them."""
    out = conn.filter(S.is_external_like(F.col("dst_ip"))).groupBy("dst_ip").agg(F.sum(total_bytes()).alias("bytes"), F.count(F.lit(1)).alias("connections"))
    number = out.agg(F.count(F.lit(1)).alias("n_external"))
    return top(out, n, "bytes", "dst_ip").crossJoin(F.broadcast(number))  # one row


def service_risk(conn: DataFrame, n: int = 20) -> DataFrame:
    """services with the risk of their TCP port."""
    risks = refdata.frame(conn.sparkSession, refdata.PORT_RISKS, "risk_port int,risk_protocol string,risk_level string")
    out = services(conn, n)
    return out.join(F.broadcast(risks), (F.col("dst_port") == F.col("risk_port")) & (F.col("protocol") == F.col("risk_protocol")), "left").drop("risk_port", "risk_protocol")
