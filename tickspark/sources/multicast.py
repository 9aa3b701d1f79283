"""Datagrams of a multicast group, or of a plain UDP port, as a stream: spark.readStream.format("udp").

Options: group (an address; one that isn't multicast is bound as it is), port, interface (of the group's
membership), most (datagrams of a batch), wait (seconds that an empty socket is waited for) and
buffer (bytes that the system holds for the socket). Datagrams are read on the driver, up to `most` a
batch, and go on as rows. A datagram can't be asked for again: those of a batch that a stopped query hadn't
finished are lost, as UDP itself loses some; `number` counts what arrived. Feeds that must be whole go
through a log such as Kafka.
"""

from __future__ import annotations

import ipaddress
import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

LARGEST = 65_535


def listen(group: str, port: int, interface: str = "0.0.0.0", buffer: int = 1 << 24) -> socket.socket:
    """A socket that gets the datagrams sent to group and port."""
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, buffer)
    s.bind((group, port))
    if ipaddress.ip_address(group).is_multicast:
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, struct.pack("4s4s", socket.inet_aton(group), socket.inet_aton(interface)))
    return s


def drain(s: socket.socket, most: int, wait: float) -> list[tuple[int, bytes]]:
    """Arrival times in nanoseconds and datagrams, until there are `most` or none comes for `wait` seconds."""
    out = []
    s.settimeout(wait)
    while len(out) < most:
        try:
            value = s.recv(LARGEST)
        except TimeoutError:
            break
        out.append((time.time_ns(), value))
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.most, self.wait = int(options.get("most", 10_000)), float(options.get("wait", 0.2))
        self.at = options["group"], int(options["port"]), options.get("interface", "0.0.0.0"), int(options.get("buffer", 1 << 24))
        self.socket: socket.socket | None = None

    def initialOffset(self) -> dict:
        return {"number": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.socket = self.socket or listen(*self.at)
        first, found = start["number"], drain(self.socket, self.most, self.wait)
        return iter([(first + i, at, value) for i, (at, value) in enumerate(found)]), {"number": first + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(())

    def commit(self, end: dict) -> None:
        pass


class Datagrams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "number long, received_ns long, value binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Datagrams)
