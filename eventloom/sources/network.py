"""Syslog over UDP and TCP as Spark data sources, and the settings of listeners.

``spark.dataSource.register(SyslogUdp)`` and then ``spark.readStream.format("syslog_udp").option("host", ...)``: rows
``(conn_id, seq, data)``, one for each datagram, or for each chunk read from a TCP connection. The driver's reader
listens and hands the chunks out in micro-batches; framing and parsing run on the executors. What arrived is kept until
the batch that holds it is committed, so a failed batch is read again. At most ``max_pending`` bytes wait: then TCP
senders are held back, and datagrams are dropped. After a restart numbering goes on from the query's checkpoint; what the
stopped driver held and had not committed is lost, as the senders of this protocol do not repeat it.
"""

from __future__ import annotations

import contextlib
import socket
import threading
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

CHUNK = 65_536
PENDING = 64 << 20


@dataclass(frozen=True)
class Tls:
    """Transport security of a TCP listener: settings only, the transport is the platform's."""

    keystore: str
    keystore_password: str
    truststore: str | None = None
    truststore_password: str | None = None
    client_auth: str = "ignored"

    def __post_init__(self):
        if self.client_auth not in ("required", "requested", "ignored"):
            raise ValueError(f"client_auth is required, requested or ignored, not {self.client_auth!r}")


@dataclass(frozen=True)
class Listener:
    name: str
    kind: str
    host: str = "127.0.0.1"
    port: int = 514
    idle_timeout: float | None = None
    max_connections: int | None = None
    max_message_size: int = 1_000_000
    tls: Tls | None = None

    def __post_init__(self):
        if self.kind not in ("syslog_udp", "syslog_tcp"):
            raise ValueError(f"unknown source type {self.kind!r}")
        if self.kind == "syslog_udp" and self.tls:
            raise ValueError("UDP has no transport security")

    @staticmethod
    def of(found: dict) -> Listener:
        tls = found.get("tls")
        return Listener(**{**found, "tls": Tls(**tls) if tls else None})


class _Inbox:
    """Chunks that arrived, numbered from ``first``; at most about ``most`` bytes wait at a time."""

    def __init__(self, first: int = 0, most: int = PENDING):
        self.room, self.first, self.rows, self.most, self.size, self.dropped = threading.Condition(), first, [], most, 0, 0

    def add(self, conn: str, seq: int, data: bytes, wait: bool) -> None:
        """Takes a chunk in. Where there is no room, it waits (the sender is held back), or drops and counts the chunk."""
        with self.room:
            while self.size >= self.most:
                if not wait:
                    self.dropped += 1
                    return
                self.room.wait()
            self.rows.append((conn, seq, data))
            self.size += len(data)

    def between(self, start: int, end: int | None = None) -> tuple[list, int]:
        with self.room:
            stop = self.first + len(self.rows) if end is None else end
            return self.rows[max(0, start - self.first) : max(0, stop - self.first)], stop

    def forget(self, end: int) -> None:
        with self.room:
            done = min(len(self.rows), max(0, end - self.first))
            self.size -= sum(len(data) for _, _, data in self.rows[:done])
            self.rows, self.first = self.rows[done:], self.first + done
            self.room.notify_all()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options.get("port", 0))
        self.idle = float(options["idle_timeout"]) if "idle_timeout" in options else None
        self.most = int(options.get("max_connections", 1000))
        self.pending = int(options.get("max_pending", PENDING))
        self.inbox = None

    def _start(self, first: int) -> None:
        """Listens; what arrives is numbered on from ``first``, where an earlier run of the query stopped."""
        if self.inbox is None:
            self.inbox = _Inbox(first, self.pending)
            self.socket = self.listen()
            threading.Thread(target=self.serve, daemon=True).start()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict):
        self._start(start["at"])
        rows, end = self.inbox.between(start["at"])
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        self._start(end["at"])
        return iter(self.inbox.between(start["at"], end["at"])[0])

    def commit(self, end: dict) -> None:
        if self.inbox:
            self.inbox.forget(end["at"])


class _UdpReader(_Reader):
    def listen(self):
        made = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        made.bind((self.host, self.port))
        return made

    def serve(self) -> None:
        seq = 0
        while True:
            data, peer = self.socket.recvfrom(CHUNK)
            self.inbox.add(f"{peer[0]}:{peer[1]}", seq, data, wait=False)
            seq += 1


class _TcpReader(_Reader):
    def listen(self):
        made = socket.create_server((self.host, self.port))
        self.open = threading.Semaphore(self.most)
        return made

    def serve(self) -> None:
        while True:
            conn, peer = self.socket.accept()
            if not self.open.acquire(blocking=False):
                conn.close()
                continue
            threading.Thread(target=self.drain, args=(conn, f"{peer[0]}:{peer[1]}"), daemon=True).start()

    def drain(self, conn: socket.socket, name: str) -> None:
        seq = 0
        conn.settimeout(self.idle)
        with contextlib.suppress(OSError), conn:
            while data := conn.recv(CHUNK):
                self.inbox.add(name, seq, data, wait=True)
                seq += 1
        self.open.release()


class _Syslog(DataSource):
    def schema(self) -> str:
        return "conn_id string, seq long, data binary"


class SyslogUdp(_Syslog):
    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def simpleStreamReader(self, schema):  # noqa: N802
        return _UdpReader(self.options)


class SyslogTcp(_Syslog):
    @classmethod
    def name(cls) -> str:
        return "syslog_tcp"

    def simpleStreamReader(self, schema):  # noqa: N802
        return _TcpReader(self.options)
