"""MySQL and MariaDB: packets, handshake, prepared statements, replies and transactions."""

from __future__ import annotations

import re
from collections import OrderedDict

from wiretally import schema as S
from wiretally.streaming.core import RECV, SEND, Connection, Framer, Handler, observation

# Capability and status bits, commands, limits.
CONNECT_WITH_DB, PROTOCOL_41, COMPRESS, SSL, SECURE, PLUGIN, LENENC_AUTH, DEPRECATE_EOF = (
    8, 0x200, 0x20, 0x800, 0x8000, 0x80000, 0x200000, 0x1000000
)
IN_TRANS, MORE_RESULTS, CURSOR, LAST_ROW = 1, 8, 0x40, 0x80
QUIT, INIT_DB, QUERY, PING, CHANGE_USER, BINLOG, PREPARE, EXECUTE, CLOSE_STMT, FETCH, RESET_CONNECTION = (
    1, 2, 3, 14, 17, 18, 22, 23, 25, 28, 31
)
BINLOG_GTID = 30
COMMANDS = frozenset(range(0, 32))
FULL = 0xFFFFFF
STATEMENTS = 256


def lenenc(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a length-encoded integer; a value of -1 is null or past the end."""
    if at >= len(data):
        return -1, at
    first = data[at]
    if first < 0xFB:
        return first, at + 1
    size = {0xFC: 2, 0xFD: 3, 0xFE: 8}.get(first, 0)
    return (int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size) if size else (-1, at + 1)


def cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    end = len(data) if end < 0 else end
    return data[at:end].decode(errors="replace"), end + 1


class MyFramer(Framer):
    """Packets; full-size ones continue in the next, whose number must follow."""

    def __init__(self, handler: MySql, way: int):
        self.handler, self.way = handler, way
        self.glued: list = []
        super().__init__(4)

    def parse(self, head):
        length, number = int.from_bytes(head[:3], "little"), head[3]
        if self.glued and number != (self.glued[0] + 1) % 256:
            return None
        return number, length

    def message(self, kind, length, body, cut, ts, last):
        if self.glued:
            _, total, first, was_cut, began = self.glued
            length, body, cut, ts = total + length, first, True, began
        if length and length % FULL == 0:
            self.glued = [kind, length, body, cut, ts]
            return
        self.glued = []
        self.handler.packet(self.way, kind, length, body, cut, ts, last)

    def spoil(self):
        self.glued = []
        super().spoil()

    def resync(self, payload, starts_call, ts):
        # No byte pattern tells a packet: only a call that begins with a plausible one.
        if not starts_call or len(payload) < 5:
            return None
        length, number = int.from_bytes(payload[:3], "little"), payload[3]
        if self.way == RECV and (number or payload[4] not in COMMANDS or not length):
            return None
        self.dirty = False
        if self.way == RECV:
            self.handler.at_command()
        return payload


class MySql(Handler):
    proto = "mysql"

    def __init__(self, conn: Connection):
        super().__init__(conn)
        self.framers = {RECV: MyFramer(self, RECV), SEND: MyFramer(self, SEND)}
        self.phase = "command" if conn.synthetic else "greeting"
        self.session: dict = {"user": None, "db": None, "version": None}
        self.staged: dict = {}
        self.caps = PROTOCOL_41 | DEPRECATE_EOF if conn.synthetic else 0
        self.unit: dict | None = None
        self.statements: OrderedDict[int, str] = OrderedDict()
        self.in_trans: bool | None = None
        self.txn_start: int | None = None
        self.verb = ""
        if conn.synthetic:
            for f in self.framers.values():
                f.spoil()

    def data(self, way, payload, ts, starts_call):
        self.framers[way].feed(payload, ts, starts_call)

    def hole(self, way, n, ts):
        if not self.framers[way].skip(n, ts):
            self.drop("resync")

    def lost(self, way):
        self.framers[way].spoil()
        self.report.count("resyncs", self.proto)
        self.drop("resync")
        if self.phase != "command":
            self.phase, self.caps = "command", PROTOCOL_41 | DEPRECATE_EOF
        self.in_trans = self.txn_start = None

    def drop(self, reason: str) -> None:
        if self.unit:
            self.report.count("dropped", self.proto, reason)
        self.unit = None

    def close(self, ts):
        self.drop("disconnect")

    def at_command(self) -> None:
        """A clean command while a reply is open: the reply's end was lost."""
        self.drop("resync")

    def packet(self, way, number, length, body, cut, ts, last):
        self.report.message(self.conn.conn_id, way, body[:1].hex(), length, cut)
        if self.conn.blind:
            return
        if self.phase != "command":
            self.handshake(way, body, ts)
        elif way == RECV:
            self.command(number, length, body, cut, ts)
        elif self.unit:
            self.reply(body, cut, last, length)

    def handshake(self, way: int, body: bytes, ts: int) -> None:
        if self.phase == "greeting" and way == SEND:
            if body[:1] != b"\x0a":
                self.drop("resync")
                self.phase = "auth"
                return
            version, _ = cstring(body, 1)
            self.session["version"] = version.removeprefix("5.5.5-")[:15]
            self.phase = "response"
        elif self.phase == "response" and way == RECV:
            self.caps = int.from_bytes(body[:4], "little")
            if self.caps & SSL and len(body) <= 36:
                self.conn.tls = True
                return
            if self.caps & COMPRESS:
                self.conn.go_blind("compressed")
                return
            self.identity(body, 32)
            self.phase = "auth"
        elif self.phase == "auth" and way == SEND:
            if body[:1] == b"\x00":
                self.phase = "command"
                self.session |= self.staged
                self.in_trans = False
                self.report.sessions.append({"conn": self.conn.conn_id, "proto": self.proto, **self.session})
            elif body[:1] == b"\xff":
                self.phase = "closed"

    def identity(self, body: bytes, at: int) -> None:
        user, at = cstring(body, at)
        if self.caps & LENENC_AUTH:
            n, at = lenenc(body, at)
            at += max(n, 0)
        elif self.caps & SECURE and at < len(body):
            at += 1 + body[at]
        else:
            _, at = cstring(body, at)
        db = cstring(body, at)[0] if self.caps & CONNECT_WITH_DB else ""
        self.staged = {"user": user or None, "db": db or None}

    def command(self, number: int, length: int, body: bytes, cut: bool, ts: int) -> None:
        if self.unit and self.unit["state"] == "infile":
            self.unit["bytes"] += length
            if not length:
                self.unit["state"] = "head"
            return
        code = body[0] if body else 0
        if self.unit:
            self.drop("resync")
        if code in (QUIT, CLOSE_STMT):
            if code == CLOSE_STMT:
                self.statements.pop(int.from_bytes(body[1:5], "little"), None)
            return
        if code in (BINLOG, BINLOG_GTID):
            self.conn.go_blind("replication")
            return
        unit = {"code": code, "start": ts, "first": None, "rows": 0, "bytes": 0, "flags": 0, "text": None, "state": "head", "columns": 0, "results": 0, "kind": "simple", "stage": {}}
        if code in (QUERY, PREPARE):
            unit["text"] = body[1:].decode(errors="replace")
            unit["flags"] |= S.TEXT_TRUNC if cut else 0
            if code == QUERY:
                self.verb = (re.match(r"\s*(\w+)", unit["text"]) or [""])[0].strip().upper()
        elif code == EXECUTE:
            number = int.from_bytes(body[1:5], "little")
            unit["kind"], unit["text"] = "extended", self.statements.get(number)
            unit["flags"] |= 0 if unit["text"] is not None else S.NO_TEXT
            if number in self.statements:
                self.statements.move_to_end(number)
        elif code == INIT_DB:
            unit["stage"] = {"db": body[1:].decode(errors="replace")}
        elif code == CHANGE_USER:
            user, at = cstring(body, 1)
            at += 1 + (body[at] if at < len(body) else 0)
            unit["stage"] = {"user": user, "db": cstring(body, at)[0] or None}
        self.unit = unit

    def reply(self, body: bytes, cut: bool, ts: int, length: int) -> None:
        u = self.unit
        first = body[0] if body else -1
        state = u["state"]
        if state == "columns":
            u["columns"] -= 1
            if not u["columns"]:
                u["state"] = "rows" if self.caps & DEPRECATE_EOF else "eof"
        elif state == "eof":
            u["state"] = "rows"
        elif state == "rows":
            end = first == 0xFE and length < FULL and (self.caps & DEPRECATE_EOF or length < 9)
            if first == 0xFF:
                self.error(body, ts)
            elif end:
                self.finish(self.eof_status(body), ts)
            else:
                u["first"] = u["first"] or ts
                u["rows"] += 1
        elif state == "params":
            u["columns"] -= 1
            if not u["columns"]:
                self.unit = None
        elif cut and len(body) == 0:
            self.drop("resync")  # a reply that can't be told
        elif first == 0xFF:
            self.error(body, ts)
        elif first == 0xFB:
            u["state"] = "infile"
        elif u["code"] == PREPARE and first == 0x00:
            number = int.from_bytes(body[1:5], "little")
            self.statements[number] = u["text"]
            if len(self.statements) > STATEMENTS:
                self.statements.popitem(last=False)
            left = sum(int.from_bytes(body[i : i + 2], "little") + (0 if self.caps & DEPRECATE_EOF or not int.from_bytes(body[i : i + 2], "little") else 1) for i in (5, 7))
            u["state"], u["columns"] = "params", left
            if not left:
                self.unit = None
        elif first == 0x00:
            affected, at = lenenc(body, 1)
            _, at = lenenc(body, at)
            u["rows"] += max(affected, 0)
            self.finish(int.from_bytes(body[at : at + 2], "little"), ts)
        elif first == 0xFE and length < 9:
            self.finish(int.from_bytes(body[3:5], "little"), ts)
        else:
            n, _ = lenenc(body, 0)
            u["state"], u["columns"] = ("rows", 0) if u["code"] == FETCH else ("columns", n)
            if u["code"] == FETCH:
                u["rows"] += 1

    def eof_status(self, body: bytes) -> int:
        if not self.caps & DEPRECATE_EOF:
            return int.from_bytes(body[3:5], "little")
        _, at = lenenc(body, 1)
        _, at = lenenc(body, at)
        return int.from_bytes(body[at : at + 2], "little")

    def error(self, body: bytes, ts: int) -> None:
        u = self.unit
        u["flags"] |= S.ERROR
        u["errno"] = int.from_bytes(body[1:3], "little")
        u["sqlstate"] = body[4:9].decode("latin-1") if body[3:4] == b"#" else None
        u["stage"] = {}
        self.emit(ts)

    def finish(self, status: int, ts: int) -> None:
        u = self.unit
        u["results"] += 1
        if status & MORE_RESULTS:
            u["state"] = "head"
            u["flags"] |= S.MULTI_STMT
            return
        if status & CURSOR and not status & LAST_ROW:
            u["flags"] |= S.SUSPENDED
        self.transaction(bool(status & IN_TRANS), ts)
        self.emit(ts)
        self.session |= u["stage"]

    def emit(self, ts: int) -> None:
        u, self.unit = self.unit, None
        if u["code"] not in (QUERY, EXECUTE):
            return
        self.report.observations.append(
            observation(
                conn=self.conn.conn_id, proto=self.proto, kind=u["kind"], flags=u["flags"], db=self.session["db"], user=self.session["user"],
                ts_start_ns=u["start"], ts_first_row_ns=u["first"], ts_complete_ns=ts, ts_ready_ns=ts, text=u["text"], rows=u["rows"],
                bytes=u["bytes"], sqlstate=u.get("sqlstate"), err_code=u.get("errno"), txn_status=None if self.in_trans is None else "T" if self.in_trans else "I",
            )
        )

    def transaction(self, now: bool, ts: int) -> None:
        before, self.in_trans = self.in_trans, now
        if before is False and now:
            self.txn_start = ts
        elif before and not now and self.txn_start is not None:
            self.report.transactions.append(
                {"conn": self.conn.conn_id, "proto": self.proto, "db": self.session["db"], "user": self.session["user"], "start_ns": self.txn_start, "end_ns": ts, "aborted": self.verb == "ROLLBACK"}
            )
            self.txn_start = None
