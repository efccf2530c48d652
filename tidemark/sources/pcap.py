"""Packet captures as a Spark data source: spark.read.format("pcap").load(path).

Each file is a partition. Frames that can't be decoded stay as rows with a status.
"""

from __future__ import annotations

import glob
import ipaddress
import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import DNS_TYPES

SCHEMA = """ts double, wire_len int, status string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string,
syn boolean, ack boolean, fin boolean, rst boolean, psh boolean, urg boolean, ece boolean, cwr boolean, window int, seq bigint, payload_len int,
dns_query string, dns_type string, dns_response boolean, sni string, dns_rcode int, dns_answers array<string>"""
_WIDTH = 25


def _name(data: bytes, at: int) -> tuple[str | None, int]:
    """A domain name at a place of a DNS message, and the place behind it. Pointers go backwards only."""
    labels, behind, limit = [], None, at
    while True:
        if at >= len(data):
            return None, len(data)
        size = data[at]
        if size >= 192:
            if at + 1 >= len(data):
                return None, len(data)
            behind = behind or at + 2
            target = (size & 63) << 8 | data[at + 1]
            if target >= limit:
                return None, behind
            at = limit = target
        elif size == 0:
            return ".".join(labels), behind or at + 1
        elif size >= 64:
            return None, behind or at + 1
        else:
            labels.append(data[at + 1 : at + 1 + size].decode("ascii", "replace"))
            at += 1 + size


def _dns(data: bytes) -> tuple[str | None, str | None, bool | None, int | None, list[str] | None]:
    """First question and its type, whether it is a response, its code, and the owner names of the answers."""
    if len(data) < 17:
        return None, None, None, None, None
    flags, questions, answers = struct.unpack(">HHH", data[2:8])
    at, first = 12, (None, None)
    for k in range(questions):
        name, at = _name(data, at)
        if name is None or at + 4 > len(data):
            break
        if k == 0 and name:
            code = struct.unpack(">H", data[at : at + 2])[0]
            first = name, DNS_TYPES.get(code, f"TYPE_{code}")
        at += 4
    owners = []
    for _ in range(answers):
        name, at = _name(data, at)
        if name is None or at + 10 > len(data):
            break
        owners.append(name)
        at += 10 + struct.unpack(">H", data[at + 8 : at + 10])[0]
    return *first, bool(flags >> 15), flags & 15, owners


def _sni(data: bytes) -> str | None:
    """Server name of a TLS ClientHello."""
    try:
        if data[0] != 22 or data[5] != 1:
            return None
        at = 43 + 1 + data[43]
        at += 2 + struct.unpack(">H", data[at : at + 2])[0]
        at += 1 + data[at]
        end = at + 2 + struct.unpack(">H", data[at : at + 2])[0]
        at += 2
        while at + 4 <= end:
            kind, size = struct.unpack(">HH", data[at : at + 4])
            if kind == 0:
                n = struct.unpack(">H", data[at + 7 : at + 9])[0]
                return data[at + 9 : at + 9 + n].decode("ascii", "replace")
            at += 4 + size
    except (IndexError, struct.error):
        return None
    return None


def decode(ts: float, frame: bytes, wire_len: int) -> tuple:
    """One row of SCHEMA for one Ethernet frame."""
    blank: list = [None] * _WIDTH
    blank[0], blank[1] = ts, wire_len

    def bad(status: str) -> tuple:
        return (*blank[:2], status, *blank[3:])

    if len(frame) < 14:
        return bad("malformed")
    kind, at = struct.unpack(">H", frame[12:14])[0], 14
    if kind == 0x8100 and len(frame) >= 18:
        kind, at = struct.unpack(">H", frame[16:18])[0], 18
    if kind == 0x0800:
        if len(frame) < at + 20 or frame[at] >> 4 != 4:
            return bad("truncated_ip")
        head = (frame[at] & 15) * 4
        proto, src, dst = frame[at + 9], frame[at + 12 : at + 16], frame[at + 16 : at + 20]
        size = struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + head : at + size if head <= size <= len(frame) - at else len(frame)]
    elif kind == 0x86DD:
        if len(frame) < at + 40:
            return bad("truncated_ip")
        proto, src, dst, body = frame[at + 6], frame[at + 8 : at + 24], frame[at + 24 : at + 40], frame[at + 40 :]
    else:
        return bad("not_ip")
    row = blank
    row[2], row[3], row[4] = "ok", str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst))
    row[5], row[6], row[7] = 0, 0, {1: "ICMP", 58: "ICMP", 6: "TCP", 17: "UDP"}.get(proto, f"IP_{proto}")
    payload = body
    if proto == 6:
        if len(body) < 20:
            return bad("truncated_tcp")
        row[5], row[6], row[17] = struct.unpack(">HHI", body[:8])
        bits = body[13]
        row[8], row[9], row[10], row[11], row[12], row[13], row[14], row[15] = (bool(bits & b) for b in (2, 16, 1, 4, 8, 32, 64, 128))
        row[16] = struct.unpack(">H", body[14:16])[0]
        payload = body[(body[12] >> 4) * 4 :]
        if 443 in (row[5], row[6]):
            row[22] = _sni(payload)
    elif proto == 17:
        if len(body) < 8:
            return bad("truncated_udp")
        row[5], row[6] = struct.unpack(">HH", body[:4])
        payload = body[8:]
        if 53 in (row[5], row[6]):
            row[19], row[20], row[21], row[23], row[24] = _dns(payload)
    row[18] = len(payload)
    return tuple(row)


def frames(data: Iterator[bytes] | bytes) -> Iterator[tuple[float, bytes, int]]:
    """(time, frame, length on the wire) of a pcap or pcapng file's bytes."""
    data = bytes(data)
    if len(data) < 24:
        return
    magic = data[:4]
    if magic in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        order = "<" if magic[0] in (0xD4, 0x4D) else ">"
        unit = 1e-9 if 0x4D in (magic[0], magic[3]) else 1e-6
        at = 24
        while at + 16 <= len(data):
            sec, part, kept, wire = struct.unpack(order + "IIII", data[at : at + 16])
            yield sec + part * unit, data[at + 16 : at + 16 + kept], wire
            at += 16 + kept
    elif magic == b"\x0a\x0d\x0d\x0a":
        order, at, unit = ("<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), 0, 1e-6
        while at + 12 <= len(data):
            kind, size = struct.unpack(order + "II", data[at : at + 8])
            if size < 12:
                return
            if kind == 6:
                _, high, low, kept, wire = struct.unpack(order + "IIIII", data[at + 8 : at + 28])
                yield ((high << 32) | low) * unit, data[at + 28 : at + 28 + kept], wire
            at += size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self) -> list[_File]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        found = sorted(glob.glob(f"{self.path}/**/*.pcap*", recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            for k, (ts, frame, wire) in enumerate(frames(f.read())):
                if self.limit and k >= self.limit:
                    return
                yield decode(ts, frame, wire)


class PcapDataSource(DataSource):
    """Options: path; limit (packets of each file, 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("limit", 0)))


def register(spark: SparkSession) -> None:
    from tidemark.session import ship

    ship(spark)
    spark.dataSource.register(PcapDataSource)
