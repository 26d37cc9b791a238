"""From packets to transport segments, ARP and DNS rows, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.dims import OT_TCP_PORTS, OT_UDP_PORTS, literal_map
from fieldtrace.functions.bytesx import bits, ipv6_text, nbytes, rest, take, u8, u16, u32
from fieldtrace.functions.net import ipv4_text, mac_text
from fieldtrace.operators.settle import settle

VLAN_TAGS = [0x8100, 0x88A8, 0x9100]
VLAN_STEPS = 3      # tags taken as plain steps; frames with more of them are walked
RAW_LINKS = [12, 14, 101, 228]


def dissect_link(packets: DataFrame) -> DataFrame:
    """Network-layer bytes, EtherType (4 or 6 as type for raw links) and source MAC of each packet."""
    d, link = F.col("data"), F.col("linktype")
    rows = packets.withColumn("_kind", u16(d, 12)).withColumn("_skip", F.lit(14))
    for _ in range(VLAN_STEPS):
        # a step per tag: each reads at the offset the step before settled
        tagged = F.col("_kind").isin(VLAN_TAGS)
        rows = rows.withColumn("_next", F.when(tagged, F.col("_skip") + 4).otherwise(F.col("_skip")))
        rows = rows.withColumn("_kind", F.when(tagged, u16(d, F.col("_skip") + 2)).otherwise(F.col("_kind"))).withColumn("_skip", F.col("_next"))

    def deeper(at: Column, _: Column) -> Column:
        return F.when(u16(d, at - 2).isin(VLAN_TAGS), at + 4).otherwise(at)
    deep = F.col("_kind").isin(VLAN_TAGS)
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.expr("(octet_length(data) - _skip) div 4").cast("int"), F.lit(1))), F.col("_skip"), deeper)
    rows = rows.withColumn("_next", F.when(deep, walked).otherwise(F.col("_skip")))
    rows = rows.withColumn("_kind", F.when(deep, u16(d, F.col("_next") - 2)).otherwise(F.col("_kind"))).withColumn("_skip", F.col("_next"))
    version = F.shiftright(u8(d, F.when(link == 0, 4).otherwise(0)), 4)
    ip = F.when(version == 4, 0x0800).when(version == 6, 0x86DD)
    ether = F.when(link == 1, F.col("_kind")).when(link == 113, u16(d, 14)).when(link == 276, u16(d, 0)).when(
        link.isin(0, *RAW_LINKS), ip).when(link == 229, 0x86DD)
    skip = F.when(link == 1, F.col("_skip")).when(link == 113, 16).when(link == 276, 20).when(link == 0, 4).otherwise(0)
    rows = settle(rows, ether_type=ether, src_mac=F.when(link == 1, mac_text(take(d, 6, 6))).otherwise(""), l3=rest(d, skip))
    return rows.where("ether_type IS NOT NULL").drop("_kind", "_skip", "_next")


def dissect_ipv4(frames: DataFrame) -> DataFrame:
    """Addresses, protocol and transport bytes; padding is trimmed and later fragments carry no transport."""
    d = F.col("l3")
    ihl = bits(u8(d, 0), 15) * 4
    rows = frames.where(F.col("ether_type") == 0x0800).withColumn("_ihl", ihl).where((nbytes(d) >= 20) & (F.col("_ihl") >= 20) & (nbytes(d) >= F.col("_ihl")))
    total = u16(d, 2)
    trimmed = F.when((total >= F.col("_ihl")) & (total < nbytes(d)), take(d, 0, total)).otherwise(d)
    rows = rows.withColumn("ip_len", total).withColumn("_ip", trimmed)
    return (rows.withColumn("ip_proto", u8(d, 9)).withColumn("src_ip", ipv4_text(take(d, 12, 4))).withColumn("dst_ip", ipv4_text(take(d, 16, 4)))
            .withColumn("l4", F.when(bits(u16(d, 6), 0x1FFF) == 0, rest(F.col("_ip"), F.col("_ihl")))).drop("_ihl", "_ip"))


def dissect_ipv6(frames: DataFrame) -> DataFrame:
    """As for IPv4; extension headers are skipped, later fragments are dropped."""
    d = F.col("l3")
    rows = frames.where((F.col("ether_type") == 0x86DD) & (nbytes(d) >= 40))
    size = u16(d, 4)
    body = rest(d, 40)
    rows = rows.withColumn("_p", F.when((size > 0) & (size < nbytes(body)), take(body, 0, size)).otherwise(body))
    p = F.col("_p")

    def skip(state: Column, _: Column) -> Column:
        more = state["next"].isin(0, 43, 60) & (nbytes(p) - state["at"] >= 8)
        return F.when(more, F.struct(u8(p, state["at"]).alias("next"), (state["at"] + (u8(p, state["at"] + 1) + 1) * 8).cast("int").alias("at"))).otherwise(state)
    start = F.struct(u8(d, 6).alias("next"), F.lit(0).alias("at"))
    # a header has eight bytes at least; packets without any take no step
    most = F.when(u8(d, 6).isin(0, 43, 60), F.sequence(F.lit(1), F.greatest(F.expr("octet_length(_p) div 8").cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_h", F.aggregate(most, start, skip))
    nxt, at = F.col("_h.next"), F.col("_h.at")
    fragment = nxt == 44
    rows = rows.where(~fragment | ((nbytes(p) - at >= 8) & (F.shiftright(u16(p, at + 2), 3) == 0)))
    return (rows.withColumn("ip_proto", F.when(fragment, u8(p, at)).otherwise(nxt)).withColumn("l4", rest(p, F.when(fragment, at + 8).otherwise(at)))
            .withColumn("ip_len", nbytes(d)).withColumn("src_ip", ipv6_text(take(d, 8, 16))).withColumn("dst_ip", ipv6_text(take(d, 24, 16)))
            .drop("_p", "_h"))


def dissect_tcp_udp(datagrams: DataFrame) -> DataFrame:
    """Ports, flags, sequence number and payload; anything else keeps its row with nulls, for the byte counters."""
    d, proto = F.col("l4"), F.col("ip_proto")
    offset = F.shiftright(u8(d, 12), 4) * 4
    tcp = (proto == 6) & (nbytes(d) >= 20) & (offset >= 20)
    udp = (proto == 17) & (nbytes(d) >= 8)
    known = tcp | udp
    rows = settle(datagrams, src_port=F.when(known, u16(d, 0)), dst_port=F.when(known, u16(d, 2)), tcp_flags=F.when(tcp, u8(d, 13)),
                  tcp_seq=F.when(tcp, u32(d, 4)), payload=F.when(tcp, rest(d, offset)).when(udp, rest(d, 8)))
    return rows.select("capture", "frame_no", F.col("frame_no").alias("seq"), "ts_us", "src_mac", "src_ip", "dst_ip", "ip_proto",
                       "src_port", "dst_port", "tcp_flags", "tcp_seq", "ip_len", "payload")


def dissect(packets: DataFrame) -> DataFrame:
    """Segments of all IP packets."""
    frames = dissect_link(packets)
    cols = ["capture", "frame_no", "ts_us", "src_mac", "src_ip", "dst_ip", "ip_proto", "ip_len", "l4"]
    return dissect_tcp_udp(dissect_ipv4(frames).select(*cols).unionByName(dissect_ipv6(frames).select(*cols)))


def decode_arp(packets: DataFrame) -> DataFrame:
    d = F.col("l3")
    rows = dissect_link(packets).where((F.col("ether_type") == 0x0806) & (nbytes(d) >= 28))
    sender, target = ipv4_text(take(d, 14, 4)), ipv4_text(take(d, 24, 4))
    return rows.select("capture", F.col("frame_no").alias("seq"), "ts_us", u16(d, 6).alias("opcode"), sender.alias("sender_ip"),
                       mac_text(take(d, 8, 6)).alias("sender_mac"), target.alias("target_ip"), mac_text(take(d, 18, 6)).alias("target_mac"),
                       (sender == target).alias("is_gratuitous"))


def route_by_port(segments: DataFrame) -> DataFrame:
    """Industrial protocol of a segment by its server port, the destination port first."""
    def of(table):
        names = literal_map(table, lambda v: v)
        return F.coalesce(F.element_at(names, F.col("dst_port")), F.element_at(names, F.col("src_port")))
    return segments.withColumn("protocol", F.when(F.col("ip_proto") == 6, of(OT_TCP_PORTS)).when(F.col("ip_proto") == 17, of(OT_UDP_PORTS)))


# --------------------------------------------------------------------------- DNS

_QUESTIONS = T.ArrayType(T.StructType([T.StructField("qname", T.StringType()), T.StructField("qtype", T.IntegerType()),
                                       T.StructField("qclass", T.IntegerType())]))


def _labels(data: bytes, at: int) -> tuple[list[str], int, int | None]:
    """Labels in a row, the place after them, and where a pointer at their end leads to."""
    found = []
    while at < len(data) and 0 < data[at] < 0xC0:
        stop = at + 1 + data[at]
        if stop > len(data):                            # cut off
            return found, at + 1, None
        found.append(data[at + 1:stop].decode("utf-8", "replace"))
        at = stop
    if at >= len(data):
        return found, at, None
    if data[at] == 0:
        return found, at + 1, None
    return found, at + 2, int.from_bytes(data[at:at + 2], "big") & 0x3FFF if at + 2 <= len(data) else None


def _question(data: bytes, at: int) -> tuple[dict, int] | None:
    """The question at a place and the place of the next; a pointer is followed once, so a loop of them ends."""
    labels, at, target = _labels(data, at)
    visited = set()
    while target is not None and target not in visited:
        visited.add(target)
        more, _, target = _labels(data, target)
        labels += more
    if at + 4 > len(data):
        return None
    kind, of = (int.from_bytes(data[k:k + 2], "big") for k in (at, at + 2))
    return {"qname": ".".join(labels), "qtype": kind, "qclass": of}, at + 4


@F.pandas_udf(_QUESTIONS)
def _questions(payload: pd.Series) -> pd.Series:
    def all_of(data):
        out, at = [], 12
        for _ in range(int.from_bytes(data[4:6], "big")):
            found = _question(data, at)
            if found is None:
                break
            out.append(found[0])
            at = found[1]
        return out
    return payload.map(all_of)


def decode_dns(segments: DataFrame, requests_only: bool = False) -> DataFrame:
    """One row per DNS question of UDP port 53; responses repeat their questions unless left out."""
    d = F.col("payload")
    rows = segments.where((F.col("ip_proto") == 17) & ((F.col("dst_port") == 53) | (F.col("src_port") == 53)) & (nbytes(d) >= 12))
    flags = u16(d, 2)
    rows = (rows.withColumn("trans_id", u16(d, 0)).withColumn("is_response", F.shiftright(flags, 15) == 1).withColumn("rcode", bits(flags, 15))
            .withColumn("answer_count", u16(d, 6)).withColumn("_q", F.explode(_questions(d))))
    rows = rows.where(~F.col("is_response")) if requests_only else rows
    return rows.select("ts_us", "seq", "src_ip", "dst_ip", "src_port", "dst_port", "trans_id", "is_response", "rcode", "answer_count", "_q.*")
