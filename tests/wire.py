"""Building raw events by hand, and protocol messages."""

import struct

from wiretally import schema as S
from wiretally.sources import recordings
from wiretally.streaming import core, observe

EMPTY = dict.fromkeys(S.RAW_EVENT.names) | {"conn_id": 7, "type": 0, "dir": 0, "flags": 0, "total_len": 0, "off": 0, "cap_len": 0, "payload": b"", "decode_status": "data"}


class Wire:
    """One connection: recv() is what the server receives, send() what it sends."""

    def __init__(self, proto, synthetic=False):
        self.table, self.report, self.seq, self.ts, self.rows = observe.Table({}, proto), core.Report(), 0, 0, []
        if not synthetic:
            self.event(type=recordings.OPEN, decode_status="conn")

    def event(self, **values):
        self.seq += 1
        self.ts += 1000
        row = EMPTY | {"ts_ns": self.ts, "seq": self.seq} | values
        self.rows.append(row)
        self.table.feed(row, self.report)

    def data(self, way, payload, total=None, off=0, flags=0):
        self.event(dir=way, payload=payload, total_len=len(payload) if total is None else total, off=off, cap_len=len(payload), flags=flags)

    def recv(self, payload, **k):
        self.data(recordings.RECV, payload, **k)

    def send(self, payload, **k):
        self.data(recordings.SEND, payload, **k)

    def close(self):
        self.event(type=recordings.CLOSE, decode_status="conn")

    def lose(self, n=1):
        self.seq += n

    def get(self, *names):
        return [tuple(o[n] for n in names) for o in self.report.observations]

    def count(self, name, reason=""):
        return sum(n for (a, _, r), n in self.report.counts.items() if a == name and r == reason)


def pg(kind, body=b""):
    return kind.encode() + struct.pack(">I", len(body) + 4) + body


def startup(**pairs):
    body = struct.pack(">I", 196608) + b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in pairs.items()) + b"\0"
    return struct.pack(">I", len(body) + 4) + body


def ready(status="I"):
    return pg("Z", status.encode())


def postgres():
    w = Wire("pg")
    w.recv(startup(user="alice", database="shop", application_name="app"))
    w.send(pg("R", b"\0\0\0\0") + pg("S", b"server_version\x0016.2\0") + ready())
    return w


def resp(*words):
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in (w.encode() if isinstance(w, str) else w for w in words))


def packet(number, body):
    return len(body).to_bytes(3, "little") + bytes([number]) + body


def ok(number, status=2, affected=0):
    return packet(number, b"\0" + bytes([affected]) + b"\0" + status.to_bytes(2, "little") + b"\0\0")


CAPS = 0x200 | 8 | 0x8000 | 0x1000000


def mysql(caps=CAPS):
    w = Wire("mysql")
    w.send(packet(0, b"\x0a5.5.5-10.11.6\0" + b"\1\0\0\0" + b"12345678\0" + b"\0\0"))
    w.recv(packet(1, struct.pack("<IIB23x", caps, 1 << 24, 33) + b"root\0" + b"\x03abc" + b"shop\0"))
    w.send(ok(2))
    return w
