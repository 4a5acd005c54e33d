"""Connections, chunks and framing: what all protocol parsers share.

Parsers are plain classes without Spark. A Connection takes raw events in order and hands bytes and holes of each
direction to its protocol's handler, which reports to a Report. Whatever spans a loss is dropped and counted, never
guessed.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from wiretally import schema as S
from wiretally.sources import recordings

RECV, SEND = recordings.RECV, recordings.SEND
#: Bytes of a message's body that are kept; the rest is skipped by count.
BODY_BYTES = 16 << 10
IDLE_NS = 600 * 1_000_000_000
TLS_RECORDS = (20, 21, 22, 23)


@dataclass
class Report:
    """What a connection has to say."""

    observations: list[dict] = field(default_factory=list)
    transactions: list[dict] = field(default_factory=list)
    sessions: list[dict] = field(default_factory=list)
    messages: list[dict] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    keeps_messages: bool = True

    def message(self, conn: int, way: int, kind: str, size: int, cut: bool = False) -> None:
        if self.keeps_messages:
            self.messages.append({"conn": conn, "dir": way, "kind": kind, "len": size, "cut": cut})

    def count(self, name: str, proto: str, reason: str = "", n: int = 1) -> None:
        if n:
            self.counts[name, proto, reason] += n


def observation(**values) -> dict:
    return dict.fromkeys(S.OBSERVATION.names) | {"flags": 0, "rows": 0, "bytes": 0, "bytes_in": 0, "bytes_out": 0} | values


class Handler:
    """A protocol's side of a connection. Requests are what the server receives."""

    proto = ""

    def __init__(self, conn: Connection):
        self.conn = conn
        self.report = conn.report

    def data(self, way: int, payload: bytes, ts: int, starts_call: bool) -> None:
        raise NotImplementedError

    def hole(self, way: int, n: int, ts: int) -> None:
        raise NotImplementedError

    def lost(self, way: int) -> None:
        """Events are missing: nothing in flight can be trusted."""
        raise NotImplementedError

    def close(self, ts: int) -> None:
        raise NotImplementedError

    def reset(self) -> None:
        """Plain bytes of a TLS connection begin: framing starts anew, without a known beginning."""
        self.lost(RECV)
        self.lost(SEND)


@dataclass
class Calls:
    """Where a direction is within its present system call."""

    total: int = 0
    at: int = 0


class Connection:
    """State of one connection. feed() takes decoded rows (schema.RAW_EVENT) in order."""

    def __init__(self, conn_id: int, make, report: Report, synthetic: bool = True):
        self.conn_id, self.report = conn_id, report
        self.seq = self.tls_seq = None
        self.tls = self.decrypted = False
        self.blind = ""
        self.active_ns = 0
        self.call_no = 0
        self.place = 0
        self.calls = {RECV: Calls(), SEND: Calls()}
        self.synthetic = synthetic
        self.handler: Handler = make(self)

    def feed(self, row: dict) -> None:
        self.active_ns = max(self.active_ns, row["ts_ns"] or 0)
        kind, flags, ts = row["type"], row["flags"] or 0, row["ts_ns"]
        self.sequence(row["seq"], bool(flags & recordings.DECRYPTED))
        if flags & recordings.GAP:
            self.lose(0)
        if kind == recordings.OPEN:
            return
        if kind == recordings.CLOSE:
            self.handler.close(ts)
            return
        way, payload = row["dir"], bytes(row["payload"] or b"")
        proto = self.handler.proto
        if flags & recordings.DECRYPTED and not self.decrypted:
            # The first plain byte of a TLS connection.
            self.tls = self.decrypted = True
            self.calls = {RECV: Calls(), SEND: Calls()}
            self.handler.reset()
        elif self.tls and not flags & recordings.DECRYPTED:
            self.report.count("dropped", proto, "ciphertext")
            return
        if self.blind:
            self.report.count("discarded", proto, self.blind, row["total_len"] or 0)
            return
        self.chunk(way, row["total_len"], row["off"], payload, ts)

    def number(self, first: int) -> None:
        """Give the report's observations from the first-th on their place in the total order (schema.ORDER)."""
        for o in self.report.observations[first:]:
            o["seq"], o["place"] = self.active_ns, self.place
            self.place += 1

    def sequence(self, seq: int, decrypted: bool) -> None:
        """A number that was skipped is a loss; steps back are tolerated. Decrypted events are numbered apart."""
        last = self.tls_seq if decrypted else self.seq
        if last is not None and seq > last + 1:
            self.lose(seq - last - 1)
        elif last is None and not decrypted and seq > 1 and not self.synthetic:
            self.lose(seq - 1)
        last = seq if last is None else max(last, seq)
        if decrypted:
            self.tls_seq = last
        else:
            self.seq = last

    def lose(self, n: int) -> None:
        self.report.count("lost_events", self.handler.proto, "", n)
        for way in (RECV, SEND):
            self.calls[way] = Calls()
            self.handler.lost(way)

    def chunk(self, way: int, total: int, off: int, payload: bytes, ts: int) -> None:
        """Bytes and holes of a call: the unseen tail of the call before, gaps inside this one."""
        c, n = self.calls[way], len(payload)
        starts = off == 0
        if starts:
            if c.at < c.total:
                self.handler.hole(way, c.total - c.at, ts)
            c.total, c.at = total, 0
            self.call_no += 1
        elif total != c.total or off < c.at or off + n > total:
            self.report.count("anomalies", self.handler.proto)
            self.handler.lost(way)
            c.total, c.at = total, off
        elif off > c.at:
            self.handler.hole(way, off - c.at, ts)
        c.at = off + n
        if not self.blind and n:
            self.handler.data(way, payload, ts, starts)

    def go_blind(self, reason: str) -> None:
        """The connection speaks something that isn't parsed: counted by reason, discarded from here on."""
        self.blind = reason
        self.report.count("blind", self.handler.proto, reason)


class Framer:
    """Messages of a length-framed direction: header, kept prefix of the body, skipped rest; dirty after a loss."""

    def __init__(self, header: int):
        self.header, self.head = header, bytearray()
        self.dirty = False
        self.begin()

    def begin(self) -> None:
        self.body, self.left, self.length, self.kind, self.cut, self.ts = bytearray(), -1, 0, 0, False, 0
        self.head.clear()

    def parse(self, head: bytes) -> tuple[int, int] | None:
        """(kind, body length) of a header; None if it can't be one."""
        raise NotImplementedError

    def message(self, kind: int, length: int, body: bytes, cut: bool, ts: int, last: int) -> None:
        raise NotImplementedError

    def resync(self, payload: bytes, starts_call: bool, ts: int) -> bytes | None:
        """What to go on with in a dirty direction, or None."""
        raise NotImplementedError

    def spoil(self) -> None:
        self.begin()
        self.dirty = True

    def feed(self, payload: bytes, ts: int, starts_call: bool) -> None:
        if self.dirty:
            rest = self.resync(payload, starts_call, ts)
            if rest is None:
                return
            payload = rest
        at, n = 0, len(payload)
        while at < n or self.left == 0:
            if self.left < 0:
                take = min(self.header - len(self.head), n - at)
                if not self.head:
                    self.ts = ts
                self.head += payload[at : at + take]
                at += take
                if len(self.head) < self.header:
                    return
                found = self.parse(bytes(self.head))
                if found is None:
                    self.spoil()
                    return
                self.kind, self.length = found
                self.left = self.length
            take = min(self.left, n - at)
            keep = max(0, min(take, BODY_BYTES - len(self.body)))
            self.body += payload[at : at + keep]
            self.cut |= keep < take
            at += take
            self.left -= take
            if self.left:
                return
            self.finish(ts)
            if self.dirty:
                return

    def finish(self, last: int) -> None:
        kind, length, body, cut, ts = self.kind, self.length, bytes(self.body), self.cut, self.ts
        self.begin()
        self.message(kind, length, body, cut, ts, last)

    def skip(self, n: int, ts: int) -> bool:
        """A hole of n bytes. False: it covers a header, so the direction is dirty."""
        if self.dirty:
            return True
        if self.left < 0:
            self.spoil()
            return False
        take = min(n, self.left)
        self.cut = True
        self.left -= take
        if not self.left:
            self.finish(ts)
            if n > take:
                self.spoil()
                return False
        return True
