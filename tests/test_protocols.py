"""Replays of hand-made connections: what is observed, and what is counted as lost."""

import struct

from wire import CAPS, Wire, mysql, ok, packet, pg, postgres, ready, resp, startup

from wiretally import schema as S

# --- PostgreSQL ---


def test_pg_simple_query():
    w = postgres()
    w.recv(pg("Q", b"SELECT 1\0"))
    w.send(pg("T", b"x") + pg("D", b"1") + pg("C", b"SELECT 1\0") + ready())
    assert w.get("kind", "flags", "text", "rows", "db", "user", "app") == [("simple", 0, "SELECT 1", 1, "shop", "alice", "app")]
    o = w.report.observations[0]
    assert o["ts_start_ns"] < o["ts_first_row_ns"] <= o["ts_complete_ns"] <= o["ts_ready_ns"]


def test_pg_error():
    w = postgres()
    w.recv(pg("Q", b"BAD\0"))
    w.send(pg("E", b"SERROR\0C42601\0Mno\0\0") + ready())
    assert w.get("flags", "sqlstate") == [(S.ERROR, "42601")]


def test_pg_multi_statement():
    w = postgres()
    w.recv(pg("Q", b"SELECT 1; INSERT\0"))
    w.send(pg("C", b"SELECT 1\0") + pg("C", b"INSERT 0 5\0") + ready())
    assert w.get("flags", "rows") == [(S.MULTI_STMT, 6)]


def test_pg_empty_and_truncated():
    w = postgres()
    w.recv(pg("Q", b"\0"))
    w.send(pg("I") + ready())
    long = pg("Q", b"SELECT " + b"x" * 20000 + b"\0")
    w.recv(long)
    w.send(pg("C", b"SELECT 0\0") + ready())
    assert [f for (f,) in w.get("flags")] == [S.EMPTY, S.TEXT_TRUNC]


def test_pg_cancel():
    w = Wire("pg")
    w.recv(struct.pack(">II", 16, 80877102) + b"12345678")
    assert w.get("kind", "flags") == [("cancel", S.NO_TEXT)] and w.count("blind", "cancel") == 1


def test_pg_prepared_and_pipeline_error():
    w = postgres()
    w.recv(pg("P", b"s1\0SELECT $1\0\0\0") + 2 * (pg("B", b"\0s1\0") + pg("E", b"\0\0\0\0\0")) + pg("B", b"\0s1\0") + pg("S"))
    w.send(pg("1") + pg("2") + pg("D", b"x") + pg("C", b"SELECT 1\0") + pg("2") + pg("E", b"C22012\0\0") + ready())
    flags = [f for (f,) in w.get("flags")]
    assert flags == [0, S.PIPELINED | S.ERROR, S.PIPELINED | S.ABORTED]
    assert {t for (t,) in w.get("text")} == {"SELECT $1"}


def test_pg_two_syncs_in_flight():
    w = postgres()
    for _ in range(2):
        w.recv(pg("P", b"\0SELECT 2\0\0\0") + pg("B", b"\0\0") + pg("S"))
    w.send(pg("C", b"SELECT 1\0") + ready())
    assert len(w.report.observations) == 1
    w.send(pg("C", b"SELECT 3\0") + ready())
    assert [r for (r,) in w.get("rows")] == [1, 3]


def test_pg_bind_unknown():
    w = postgres()
    w.recv(pg("B", b"\0zz\0") + pg("S"))
    w.send(pg("s") + ready())
    assert w.get("text", "flags") == [(None, S.NO_TEXT | S.SUSPENDED)]


def test_pg_copy():
    w = postgres()
    w.recv(pg("Q", b"COPY t FROM STDIN\0"))
    w.send(pg("G", b"\0\0\0"))
    w.recv(pg("d", b"abc") + pg("d", b"defg") + pg("c"))
    w.send(pg("C", b"COPY 2\0") + ready())
    w.recv(pg("Q", b"COPY t TO STDOUT\0"))
    w.send(pg("H", b"\0\0\0") + pg("d", b"xyz") + pg("c") + pg("C", b"COPY 1\0") + ready())
    assert w.get("kind", "bytes", "rows") == [("copy_in", 7, 2), ("copy_out", 3, 1)]


def test_pg_gap_yields_nothing_for_the_unit():
    w = postgres()
    w.recv(pg("Q", b"SELECT 1\0"))
    w.lose(3)
    w.send(pg("C", b"SELECT 1\0") + ready())
    w.recv(pg("Q", b"SELECT 2\0"))
    w.send(pg("C", b"SELECT 1\0") + ready())
    assert w.get("text") == [("SELECT 2",)] and w.count("lost_events") == 3 and w.count("dropped", "resync") == 1


def test_pg_mid_session():
    w = Wire("pg", synthetic=True)
    w.recv(pg("Q", b"SELECT 0\0"))
    w.send(pg("C", b"SELECT 1\0"))
    w.send(b"x" + ready())
    w.recv(pg("Q", b"SELECT 2\0"))
    w.send(pg("C", b"SELECT 1\0") + ready())
    assert w.get("text", "user") == [("SELECT 2", None)]


def test_pg_ssl_refused_and_accepted():
    for answer in (b"N", b"S"):
        w = Wire("pg")
        w.recv(struct.pack(">II", 8, 80877103))
        w.send(answer)
        w.recv(startup(user="a"))
        w.send(pg("R", b"\0\0\0\0") + ready())
        w.recv(pg("Q", b"SELECT 3\0"))
        w.send(pg("C", b"SELECT 1\0") + ready())
        assert len(w.report.observations) == (answer == b"N")
        assert (w.count("dropped", "ciphertext") > 0) == (answer == b"S")


def test_pg_decrypted_bytes_take_over():
    w = Wire("pg")
    w.recv(struct.pack(">II", 8, 80877103))
    w.send(b"S")
    w.recv(b"\x17\x03\x03garbage")
    w.recv(startup(user="a"), flags=8)
    w.send(pg("R", b"\0\0\0\0") + ready(), flags=8)
    w.recv(pg("Q", b"SELECT 3\0"), flags=8)
    w.send(pg("C", b"SELECT 1\0") + ready(), flags=8)
    assert w.get("text") == [("SELECT 3",)]


def test_pg_split_over_calls_and_chunks():
    w = postgres()
    q = pg("Q", b"SELECT 'abcdefgh'\0")
    for i in range(len(q)):
        w.recv(q[i : i + 1])
    reply = pg("C", b"SELECT 1\0") + ready()
    w.send(reply[:4], total=len(reply))
    w.send(reply[4:], total=len(reply), off=4)
    assert w.get("text", "rows") == [("SELECT 'abcdefgh'", 1)]


def test_pg_hole_in_a_body_and_over_a_header():
    w = postgres()
    row = pg("D", b"x" * 5000)
    w.recv(pg("Q", b"SELECT big\0"))
    w.send(row[:2000], total=len(row))
    w.send(pg("C", b"SELECT 1\0") + ready())
    w.recv(pg("Q", b"SELECT lost\0"))
    w.send(row, total=len(row) + 50)
    w.send(pg("C", b"SELECT 1\0") + ready())
    assert w.get("text") == [("SELECT big",)] and w.count("dropped", "resync") == 1


def test_pg_transactions():
    w = postgres()
    for verb, status in (("BEGIN", "T"), ("BAD", "E"), ("ROLLBACK", "I"), ("BEGIN", "T"), ("COMMIT", "I")):
        w.recv(pg("Q", verb.encode() + b"\0"))
        w.send((pg("E", b"C1\0\0") if verb == "BAD" else pg("C", verb.encode() + b"\0")) + ready(status))
    assert [t["aborted"] for t in w.report.transactions] == [True, False]


def test_pg_overflow():
    w = postgres()
    w.recv(b"".join(pg("B", b"\0\0") for _ in range(70)) + pg("S"))
    w.send(b"".join(pg("C", b"SELECT 1\0") for _ in range(70)) + ready())
    assert not w.report.observations and w.count("dropped", "overflow") == 65


def test_pg_replication_is_blind():
    w = postgres()
    w.recv(pg("Q", b"START_REPLICATION\0"))
    w.send(pg("W", b"\0\0\0"))
    w.send(b"anything")
    assert w.count("blind", "replication") == 1 and w.count("discarded", "replication") == 8


# --- MySQL ---


def test_mysql_result_set():
    w = mysql()
    w.recv(packet(0, b"\x03SELECT 1"))
    w.send(packet(1, b"\x01") + packet(2, b"\x03def") + packet(3, b"\x011") + packet(4, b"\x012") + packet(5, b"\xfe\0\0\2\0\0\0"))
    assert w.get("kind", "text", "rows", "db", "user") == [("simple", "SELECT 1", 2, "shop", "root")]
    assert w.report.sessions[0]["version"] == "10.11.6"


def test_mysql_result_set_with_eof_packets():
    w = mysql(CAPS & ~0x1000000)
    w.recv(packet(0, b"\x03SELECT 1"))
    eof = b"\xfe\0\0\2\0"
    w.send(packet(1, b"\x01") + packet(2, b"\x03def") + packet(3, eof) + packet(4, b"\x011") + packet(5, eof))
    assert w.get("rows") == [(1,)]


def test_mysql_error_and_affected():
    w = mysql()
    w.recv(packet(0, b"\x03BAD"))
    w.send(packet(1, b"\xff\x28\x04#42000oops"))
    w.recv(packet(0, b"\x03UPDATE t"))
    w.send(ok(1, affected=9))
    assert w.get("flags", "sqlstate", "err_code", "rows") == [(S.ERROR, "42000", 1064, 0), (0, None, None, 9)]


def test_mysql_prepared():
    w = mysql()
    w.recv(packet(0, b"\x16SELECT ?"))
    w.send(packet(1, b"\0\5\0\0\0\1\0\1\0\0\0\0") + packet(2, b"\3def") + packet(3, b"\3def"))
    w.recv(packet(0, b"\x17\5\0\0\0\0\1\0\0\0"))
    w.send(ok(1, affected=7))
    w.recv(packet(0, b"\x19\5\0\0\0"))
    w.recv(packet(0, b"\x17\5\0\0\0\0\1\0\0\0"))
    w.send(ok(1))
    assert w.get("kind", "text", "flags") == [("extended", "SELECT ?", 0), ("extended", None, S.NO_TEXT)]


def test_mysql_multi_results_and_load_data():
    w = mysql()
    w.recv(packet(0, b"\x03A; B"))
    w.send(ok(1, status=2 | 8, affected=1) + ok(2, affected=2))
    w.recv(packet(0, b"\x03LOAD DATA"))
    w.send(packet(1, b"\xfbfile"))
    w.recv(packet(2, b"12345") + packet(3, b""))
    w.send(ok(4, affected=3))
    assert w.get("rows", "flags", "bytes") == [(3, S.MULTI_STMT, 0), (3, 0, 5)]


def test_mysql_labels_commit_on_ok():
    w = mysql()
    w.recv(packet(0, b"\x02other"))
    w.send(packet(1, b"\xff\x28\x04#42000no"))
    w.recv(packet(0, b"\x03SELECT a"))
    w.send(ok(1))
    w.recv(packet(0, b"\x02other"))
    w.send(ok(1))
    w.recv(packet(0, b"\x03SELECT b"))
    w.send(ok(1))
    assert w.get("db") == [("shop",), ("other",)]


def test_mysql_transactions_and_blind_zones():
    w = mysql()
    for text, status in ((b"BEGIN", 3), (b"COMMIT", 2), (b"BEGIN", 3), (b"ROLLBACK", 2)):
        w.recv(packet(0, b"\x03" + text))
        w.send(ok(1, status=status))
    assert [t["aborted"] for t in w.report.transactions] == [False, True]
    assert mysql(CAPS | 0x20).count("blind", "compressed") == 1


def test_mysql_mid_session_and_gap():
    w = Wire("mysql", synthetic=True)
    w.send(b"\x07\0\0\x05garbage")
    w.recv(packet(0, b"\x03SELECT 1"))
    w.send(ok(1))
    assert w.get("text", "db") == [("SELECT 1", None)]
    w.recv(packet(0, b"\x03SELECT 2"))
    w.lose()
    w.recv(packet(0, b"\x03SELECT 3"))
    w.send(ok(1))
    assert w.get("text")[1:] == [("SELECT 3",)]


# --- HTTP ---


def test_http_get_post_head():
    w = Wire("http")
    w.recv(b"GET /a/1?x=y HTTP/1.1\r\nHost: h\r\nAuthorization: Basic dTpw\r\nX-Request-Id: r1\r\n\r\n")
    w.send(b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\nContent-Type: text/plain; q\r\n\r\nhello")
    w.recv(b"POST /b HTTP/1.1\r\nHost: h\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n")
    w.send(b"HTTP/1.1 503 X\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\nTrailer: x\r\n\r\n")
    w.recv(b"HEAD /c HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 404 N\r\nContent-Length: 9\r\n\r\n")
    assert w.get("op", "err_code", "bytes_in", "bytes_out", "flags", "user") == [
        ("GET", 200, 0, 5, 0, "u"), ("POST", 503, 3, 2, S.ERROR, None), ("HEAD", 404, 0, 0, S.CLIENT_ERR, None)
    ]
    assert w.report.observations[0]["http"]["ctype"] == "text/plain" and w.report.observations[0]["http"]["req_id"] == "r1"


def test_http_pipelined_and_overflow():
    w = Wire("http")
    w.recv(b"".join(b"GET /%d HTTP/1.1\r\n\r\n" % i for i in range(18)))
    w.send(b"HTTP/1.1 204 X\r\n\r\n" * 16)
    assert len(w.report.observations) == 16 and w.count("dropped", "overflow") == 2
    assert w.get("flags")[1] == (S.PIPELINED,)


def test_http_continue_and_early_answer():
    w = Wire("http")
    w.recv(b"PUT /e HTTP/1.1\r\nExpect: 100-continue\r\nContent-Length: 3\r\n\r\n")
    w.send(b"HTTP/1.1 100 Continue\r\n\r\n")
    w.recv(b"abc")
    w.send(b"HTTP/1.1 201 C\r\nContent-Length: 0\r\n\r\n")
    assert w.get("bytes_in", "flags", "err_code") == [(3, S.EXPECT_CONT, 201)] and w.report.observations[0]["http"]["ts_interim_ns"]


def test_http_blind_zones():
    w = Wire("http")
    w.recv(b"GET /u HTTP/1.1\r\nUpgrade: websocket\r\n\r\n")
    w.send(b"HTTP/1.1 101 S\r\n\r\n")
    w.recv(b"frames")
    assert w.get("err_code") == [(101,)] and w.count("blind", "upgrade") == 1 and w.count("discarded", "upgrade") == 6
    w = Wire("http")
    w.recv(b"CONNECT h:1 HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 200 X\r\n\r\n")
    assert w.count("blind", "connect") == 1
    w = Wire("http")
    w.recv(b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n")
    assert w.count("blind", "h2") == 1


def test_http_holes():
    w = Wire("http")
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 100000\r\n\r\n"
    w.recv(b"GET /big HTTP/1.1\r\n\r\n")
    w.send(head + b"x" * 100, total=len(head) + 100000)
    w.recv(b"GET /2 HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 204 X\r\n\r\n")
    assert w.get("text", "bytes_out") == [("/big", 100000), ("/2", 0)]


def test_http_until_close_and_unseen_body():
    w = Wire("http")
    w.recv(b"GET /c HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 200 OK\r\n\r\nabc")
    w.close()
    assert w.get("bytes_out", "flags") == [(3, 0)]
    w = Wire("http")
    w.recv(b"GET /c HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc")
    w.close()
    assert w.get("bytes_out", "flags") == [(3, S.BODY_UNSEEN)]


def test_http_doubtful_framing_is_refused():
    for head in (b"Content-Length: 3\r\nContent-Length: 4", b"Content-Length: 3\r\nTransfer-Encoding: chunked", b"Transfer-Encoding: gzip"):
        w = Wire("http")
        w.recv(b"POST /x HTTP/1.1\r\n" + head + b"\r\n\r\nabc")
        w.recv(b"GET /y HTTP/1.1\r\n\r\n")
        w.send(b"HTTP/1.1 204 X\r\n\r\n")
        assert w.get("text") == [("/y",)]


def test_http_huge_head_and_mid_stream():
    w = Wire("http")
    w.recv(b"GET /h HTTP/1.1\r\nX: " + b"a" * 17000)
    w.send(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n")
    assert w.get("text", "flags") == [("/h", S.TEXT_TRUNC | S.BODY_UNSEEN)]
    w = Wire("http", synthetic=True)
    w.send(b"rest of a body")
    w.recv(b"GET /m HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n")
    assert w.get("text") == [("/m",)]


def test_http_response_loss_keeps_other_requests():
    w = Wire("http")
    w.recv(b"GET /1 HTTP/1.1\r\n\r\nGET /2 HTTP/1.1\r\n\r\n")
    w.send(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", total=200)
    w.send(b"HTTP/1.1 204 X\r\n\r\n")
    assert w.get("text") == [("/2",)] and w.count("dropped", "resync") == 1


def test_http_trace_context():
    w = Wire("http")
    t, p = b"0af7651916cd43dd8448eb211c80319c", b"b7ad6b7169203331"
    w.recv(b"GET /t HTTP/1.1\r\ntraceparent: 00-" + t + b"-" + p + b"-01\r\ntracestate: a=b\r\n\r\n")
    w.send(b"HTTP/1.1 204 X\r\n\r\n")
    h = w.report.observations[0]["http"]
    assert (h["trace_id"], h["parent_id"], h["trace_flags"], h["tracestate"]) == (t.decode(), p.decode(), 1, "a=b")


# --- S3 ---


def s3_exchange(request, reply):
    w = Wire("s3")
    w.recv(request)
    w.send(reply)
    return w.report.observations[0]


def test_s3_get_put_list():
    o = s3_exchange(b"GET /bkt/secret/key HTTP/1.1\r\nAuthorization: AWS4-HMAC-SHA256 Credential=AK1/2/x, Sig\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabcd")
    assert (o["route"], o["db"], o["user"], o["obj_bytes"]) == ("GetObject", "bkt", "AK1", 4) and "secret" not in repr(o)
    o = s3_exchange(b"PUT /bkt/k HTTP/1.1\r\nContent-Length: 9\r\nx-amz-decoded-content-length: 5\r\n\r\n5;sig=ab\n", b"HTTP/1.1 200 OK\r\nx-amz-version-id: v9\r\nContent-Length: 0\r\n\r\n")
    assert (o["route"], o["obj_bytes"], o["user"], o["http"]["obj_version"]) == ("PutObject", 5, "-", "v9")
    o = s3_exchange(b"GET /bkt?list-type=2 HTTP/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n")
    assert o["route"] == "ListObjectsV2"


def test_s3_multipart_copy_internal():
    ok_ = b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n"
    assert s3_exchange(b"PUT /bkt/k?partNumber=1&uploadId=u HTTP/1.1\r\nx-amz-copy-source: /a/b\r\n\r\n", ok_)["route"] == "UploadPartCopy"
    o = s3_exchange(b"GET /minio/health/live HTTP/1.1\r\n\r\n", ok_)
    assert o["route"] == "internal" and o["flags"] & S.INTERNAL


def test_s3_errors_and_presigned():
    body = b"<Error><Code>NoSuchKey</Code></Error>"
    o = s3_exchange(b"GET /bkt/k?X-Amz-Credential=AK2%2F2024 HTTP/1.1\r\n\r\n", b"HTTP/1.1 404 N\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
    assert (o["err_name"], o["user"], o["flags"]) == ("NoSuchKey", "AK2", S.CLIENT_ERR)
    o = s3_exchange(b"HEAD /bkt/k HTTP/1.1\r\n\r\n", b"HTTP/1.1 403 N\r\nx-minio-error-code: Odd\r\n\r\n")
    assert o["err_name"] == "other"


# --- Redis ---


def test_redis_pipeline_and_labels():
    w = Wire("redis")
    w.recv(resp("SET", "k", "v") + resp("GET", "k"))
    w.send(b"+OK\r\n$1\r\nv\r\n")
    w.recv(resp("SELECT", "3"))
    w.send(b"+OK\r\n")
    w.recv(resp("GET", "x"))
    w.send(b"-WRONGTYPE bad\r\n")
    assert w.get("route", "db", "err_name") == [("SET", "0", None), ("GET", "0", None), ("SELECT", "0", None), ("GET", "3", "WRONGTYPE")]
    assert [o["redis"]["pipeline_depth"] for o in w.report.observations] == [2, 2, 1, 1]


def test_redis_redirects_arent_errors():
    w = Wire("redis")
    w.recv(resp("GET", "x"))
    w.send(b"-MOVED 1 a:1\r\n")
    assert w.get("flags", "err_name") == [(0, "MOVED")] and w.report.observations[0]["redis"]["redirect"] == "MOVED"


def test_redis_multi():
    w = Wire("redis")
    for command, reply in ((("MULTI",), b"+OK\r\n"), (("SET", "a", "b"), b"+QUEUED\r\n"), (("EXEC",), b"*1\r\n+OK\r\n"), (("MULTI",), b"+OK\r\n"), (("EXEC",), b"*-1\r\n")):
        w.recv(resp(*command))
        w.send(reply)
    assert [t["aborted"] for t in w.report.transactions] == [False, True]
    assert w.get("flags")[1] == (S.QUEUED,) and w.report.observations[2]["redis"]["txn_size"] == 1
    assert w.report.transactions[0]["start_ns"] == w.report.observations[0]["ts_start_ns"]


def test_redis_pubsub():
    w = Wire("redis")
    w.recv(resp("SUBSCRIBE", "a", "b"))
    for n, c in enumerate((b"a", b"b"), 1):
        w.send(b"*3\r\n$9\r\nsubscribe\r\n$1\r\n%s\r\n:%d\r\n" % (c, n))
    w.send(b"*3\r\n$7\r\nmessage\r\n$1\r\na\r\n$2\r\nhi\r\n")
    assert w.get("route") == [("SUBSCRIBE",)] and w.count("pushes") == 1


def test_redis_resp3():
    w = Wire("redis")
    w.recv(resp("HELLO", "3", "AUTH", "bob", "sesame"))
    w.send(b"%1\r\n+server\r\n+redis\r\n")
    w.recv(resp("HGETALL", "h"))
    w.send(b">2\r\n+invalidate\r\n*0\r\n" + b"|1\r\n+ttl\r\n:1\r\n" + b"%1\r\n$1\r\na\r\n,1.5\r\n")
    assert w.get("route", "user") == [("HELLO", "default"), ("HGETALL", "bob")]
    assert w.count("pushes") == 1 and "sesame" not in repr(w.report)


def test_redis_blocking_inline_and_bulk_hole():
    w = Wire("redis")
    w.recv(b"PING\r\n")
    w.send(b"+PONG\r\n")
    w.recv(resp("BLPOP", "k", "0"))
    w.send(b"*-1\r\n")
    w.recv(resp("GET", "k"))
    value = b"$5000\r\n" + b"x" * 5000 + b"\r\n"
    w.send(value[:500], total=len(value))
    w.recv(resp("GET", "z"))
    w.send(b"$-1\r\n")
    assert w.get("route", "flags") == [("PING", 0), ("BLPOP", S.BLOCKING), ("GET", 0), ("GET", S.PIPELINED)]
    assert w.get("bytes_out")[2] == (len(value),)


def test_redis_hole_elsewhere_drops():
    w = Wire("redis")
    w.recv(resp("GET", "a"))
    w.send(b"*2\r\n:1\r\n", total=50)
    w.recv(resp("SELECT", "2"))
    w.lose()
    w.send(b"+OK\r\n")
    w.recv(resp("GET", "b"))
    w.send(b"$-1\r\n")
    assert w.get("route", "db") == [("GET", "?")] and w.count("dropped", "resync") >= 1


def test_redis_mid_stream_and_blind():
    w = Wire("redis", synthetic=True)
    w.recv(resp("GET", "k"))
    w.send(b"$-1\r\n")
    assert w.get("db", "user") == [("?", "?")]
    w.recv(resp("MONITOR"))
    w.send(b"+OK\r\n")
    assert w.count("blind", "monitor") == 1


def test_redis_overflow_drops_the_newest():
    w = Wire("redis")
    w.recv(resp("GET", "k") * 300)
    w.send(b"$-1\r\n" * 300)
    assert len(w.report.observations) == 256 and w.count("dropped", "overflow") == 44


def redis_traffic(rng, n):
    """Batches of commands and their replies in one or more calls: (way, payload) with a mark in each command and reply."""
    out, k = [], 0
    for _ in range(n):
        batch = rng.choice((1, 1, 1, 2, 4))
        out.append(("recv", b"".join(resp("GET", "k%d" % (k + i)) for i in range(batch))))
        replies = [b"$%d\r\nv%d\r\n" % (len(str(k + i)) + 1, k + i) if rng.random() < 0.8 else b"-ERR k%d\r\n" % (k + i) for i in range(batch)]
        if rng.random() < 0.5:
            out.append(("send", b"".join(replies)))
        else:
            out += [("send", r) for r in replies]
        k += batch
    return out


def test_redis_pairs_are_right_over_losses():
    """Whatever is lost on either side, and wherever the stream is taken up: no wrong pair, and none that ends before it starts."""
    import random

    from wiretally.functions import redis as names
    from wiretally.streaming import resp as module

    rng, seen, pairs = random.Random(12), 0, []
    original = module.Redis.finish

    def spy(self, u, kind, words, began, ts):
        pairs.append((u["key"], words[0].split(b" ")[-1][1:]))
        original(self, u, kind, words, began, ts)

    effect = names.session_effect
    module.Redis.finish = spy
    try:
        for round_ in range(300):
            events = redis_traffic(rng, 25)
            w = Wire("redis", synthetic=round_ % 2 == 1)
            start = rng.randrange(6) if round_ % 2 else 0
            for way, payload in events[start:]:
                if rng.random() < 0.08:
                    w.lose()
                    continue
                before = len(w.table.held[7].handler.units) if 7 in w.table.held else 0
                getattr(w, way)(payload)
                if 7 in w.table.held and way == "recv":
                    units = w.table.held[7].handler.units
                    marks = [x[1:] for x in payload.split(b"\r\n") if x[:1] == b"k"]
                    for u, mark in zip(list(units)[len(units) - len(marks):], marks, strict=True) if len(units) >= len(marks) else ():
                        u["key"] = mark
            seen += len(w.report.observations)
            assert all(o["ts_start_ns"] <= o["ts_complete_ns"] for o in w.report.observations)
    finally:
        module.Redis.finish = original
    assert seen > 4000 and effect is names.session_effect
    assert all(a == b for a, b in pairs)


def test_redis_orphan_reply_shifts_nothing():
    w = Wire("redis", synthetic=True)
    w.send(b"$4\r\nlate\r\n")
    for command, reply in ((("GET", "a"), b"-WRONGTYPE no\r\n"), (("SET", "a", "b"), b"+OK\r\n"), (("SELECT", "3"), b"-ERR no\r\n")):
        w.recv(resp(*command))
        w.send(reply)
    assert w.get("route", "err_name", "db") == [("GET", "WRONGTYPE", "?"), ("SET", None, "?"), ("SELECT", "ERR", "?")]
    assert w.count("orphans") == 1


def test_redis_late_reply_after_a_timeout():
    """A late reply isn't taken for that of the next command; pairs begin anew once as many replies as commands have come."""
    w = Wire("redis")
    w.recv(resp("GET", "slow"))
    w.ts += 31_000_000_000
    w.recv(resp("SET", "a", "b"))
    w.send(b"$4\r\nslow\r\n")
    w.send(b"+OK\r\n")
    w.recv(resp("DEL", "a"))
    w.send(b":1\r\n")
    assert w.get("route") == [("DEL",)] and w.count("dropped", "timeout") == 2 and w.count("orphans") == 2
    w.recv(resp("GET", "never"))
    w.ts += 31_000_000_000
    w.recv(resp("GET", "x"))
    w.ts += 31_000_000_000
    w.recv(resp("TTL", "x"))
    w.send(b":5\r\n")
    assert w.get("route") == [("DEL",), ("TTL",)]


def test_redis_reply_before_the_end_of_its_command():
    """A command beyond the capture budget is known to end only with the next call; its reply waits for it."""
    w = Wire("redis")
    value = resp("SET", "k", "v" * 3000)
    w.recv(value[:400], total=len(value))
    w.send(b"+OK\r\n")
    w.recv(resp("GET", "k"))
    w.send(b"$1\r\nv\r\n")
    assert w.get("route") == [("SET",), ("GET",)] and w.count("orphans") == 0


def test_places_are_a_total_order():
    w = Wire("redis")
    w.recv(resp("GET", "k") * 3)
    w.send(b"+OK\r\n" * 3)
    w.recv(resp("GET", "k"))
    w.send(b"+OK\r\n")
    got = w.get(*S.ORDER)
    assert got == sorted(set(got)) and [p for _, _, p in got] == [0, 1, 2, 3] and got[0][0] == got[2][0] < got[3][0]


def test_every_cut_of_a_stream_gives_the_same():
    """Framing doesn't depend on where calls are cut."""
    stream = resp("SET", "k", "v" * 100) + resp("CONFIG", "GET", "x")
    for at in range(1, len(stream)):
        w = Wire("redis")
        w.recv(stream[:at])
        w.recv(stream[at:])
        w.send(b"+OK\r\n*0\r\n")
        assert w.get("route") == [("SET",), ("CONFIG|GET",)]
