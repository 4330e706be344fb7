"""Ethernet, IPv4 and UDP headers of binary frames, as expressions.

Each header is a struct, or null where the frame is too short or says it is
something else; short frames are told by their length, as a substring of a
binary column is silently shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the protocols.
ETHERNET, UDP_HEADER, UDP = 14, 8, 17
ETHERTYPES = {0x0800: "Ipv4", 0x86DD: "Ipv6", 0x0806: "Arp"}


def number(data: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of `size` bytes at a 0-based place."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(F.hex(data), at * 2 + 1, F.lit(2 * size)), 16, 10).cast("int")


def _mac(data: Column, at: int) -> Column:
    return F.lower(F.concat_ws(":", *[F.substring(F.hex(data), 2 * (at + i) + 1, 2) for i in range(6)]))


def _ip(data: Column, at: int) -> Column:
    return F.concat_ws(".", *[number(data, at + i, 1) for i in range(4)])


def ethernet(data: Column) -> Column:
    """destination, source, ethertype and its kind; null under 14 bytes."""
    t = number(data, 12, 2)
    kind = F.lit("Other")
    for code, name in ETHERTYPES.items():
        kind = F.when(t == code, name).otherwise(kind)
    return F.when(F.octet_length(data) >= ETHERNET, F.struct(_mac(data, 0).alias("destination"), _mac(data, 6).alias("source"), t.alias("ethertype"), kind.alias("kind")))


def ipv4(data: Column) -> Column:
    """header_len, protocol, src, dst of an IPv4 frame whose header is whole."""
    first = number(data, ETHERNET, 1)
    size = first.bitwiseAND(15) * 4
    room = F.octet_length(data) - ETHERNET
    ok = (F.octet_length(data) >= ETHERNET) & (number(data, 12, 2) == 0x0800) & (room >= 20) & (F.shiftright(first, 4) == 4) & (size >= 20) & (size <= room)
    return F.when(ok, F.struct(size.alias("header_len"), number(data, ETHERNET + 9, 1).alias("protocol"), _ip(data, ETHERNET + 12).alias("src"), _ip(data, ETHERNET + 16).alias("dst")))


def udp(data: Column) -> Column:
    """src_port, dst_port, length of a UDP datagram in an IPv4 frame."""
    ip = ipv4(data)
    at = ip["header_len"] + ETHERNET
    ok = (ip["protocol"] == UDP) & (F.octet_length(data) >= at + UDP_HEADER)
    return F.when(ok, F.struct(number(data, at, 2).alias("src_port"), number(data, at + 2, 2).alias("dst_port"), number(data, at + 4, 2).alias("length")))


def udp_payload(data: Column) -> Column:
    """All bytes after the UDP header, padding included; null if there is no such header."""
    at = ipv4(data)["header_len"] + ETHERNET + UDP_HEADER
    return F.when(udp(data).isNotNull(), F.substring(data, at + 1, F.octet_length(data)))


def is_udp(data: Column) -> Column:
    """Whether a frame holds a whole UDP header; how the frame is made is worked out once, whatever the optimiser does."""
    return F.coalesce(F.exists(F.array(data), lambda d: _udp_at(d).isNotNull()), F.lit(False))


def _udp_at(d: Column) -> Column:
    """Where the UDP header of an IPv4 frame begins, or null."""
    first, room = number(d, ETHERNET, 1), F.octet_length(d) - ETHERNET
    size = first.bitwiseAND(15) * 4
    ok = (room >= 20) & (number(d, 12, 2) == 0x0800) & (number(d, ETHERNET + 9, 1) == UDP) & (F.shiftright(first, 4) == 4) & (size >= 20) & (size + UDP_HEADER <= room)
    return F.when(ok, size + ETHERNET)


def in_group(data: Column, group: str, port: int) -> Column:
    """UDP frames to a multicast group and port."""
    address = "".join(f"{int(x):02X}" for x in group.split("."))
    to_group = lambda d: (F.hex(F.substring(d, ETHERNET + 17, 4)) == address) & (number(d, _udp_at(d) + 2, 2) == port)
    return F.coalesce(F.exists(F.array(data), to_group), F.lit(False))
