"""Routes, redaction, S3 and Redis identities: tables of inputs and results."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.functions import redis, route, s3, url

PATHS = {
    "/": "/", "/hi": "/hi", "/o/42/i/7": "/o/{id}/i/{id}", "/api/v1/users": "/api/v1/users", "/api/v2beta/x": "/api/v2beta/x",
    "/u/3F2504E0-4F89-11D3-9A0C-0305E82C3301": "/u/{id}", "/e/01ARZ3NDEKTSV4RRFFQ69G5FAV": "/e/{id}", "/c/a83bf2ef": "/c/{id}", "/c/a83bf2e": "/c/{id}",
    "/c/decade": "/c/decade", "/l/2024-01-02": "/l/{id}", "/x/thisisaveryverylongsegmentindeed": "/x/{id}", "/x/2024q1": "/x/{id}",
    "/x/aGVsbG8gd29ybGQx": "/x/{id}", "/x/AUTHENTICATION": "/x/AUTHENTICATION", "/s/app.a83bf2ef.js": "/s/{file}.js", "/s/index.html": "/s/index.html",
    "/s/logo.2x.png": "/s/logo.2x.png", "/d/1234.json": "/d/{file}.json", "/d/r.2024-01-02.csv": "/d/{file}.csv", "/x/name.extension1": "/x/name.extension1",
    "/x/1.2.3": "/x/1.2.3", "/x/.hidden": "/x/.hidden", "/a//b": "/a//b", "/a/b/": "/a/b/", "/x/%2E%2E": "/x/%2E%2E", "*": "*", "/a/b\tc/d": "/a/{id}/d",
    "/1/2/3/4/5/6/7/8/9": "/{id}/{id}/{id}/{id}/{id}/{id}/{id}/{id}/...", "/search?q=secret": "/search",
}
REDACTED = {
    "/a": "/a", "": "", "/s?q=cats&page=2": "/s?q=cats&page=2", "/a?token=x": "/a?token=***", "/a?access_token=a.b": "/a?access_token=***", "/a?TOKEN=x&p=1": "/a?TOKEN=***&p=1",
    "/a?X-Amz-Signature=ab": "/a?X-Amz-Signature=***", "/a?p=1;token=s": "/a?p=1;token=***", "/a?token": "/a?token", "/a?token=": "/a?token=***", "/token/1?page=2": "/token/1?page=2",
    "/a?key=1": "/a?key=***", "/a?code=4/0A": "/a?code=***",
}
OPERATIONS = [
    ("GET", "/", "", False, "ListBuckets"), ("GET", "/bkt", "", False, "ListObjects"), ("GET", "/bkt/", "list-type=2&prefix=a/", False, "ListObjectsV2"),
    ("GET", "/bkt", "list-type=9", False, "ListObjects"), ("PUT", "/bkt/k", "partNumber=1&uploadId=u", False, "UploadPart"), ("PUT", "/bkt/k", "uploadId=u", True, "UploadPartCopy"),
    ("PUT", "/bkt/k", "", True, "CopyObject"), ("DELETE", "/bkt", "acl", False, "other"), ("POST", "/bkt/k", "uploads", False, "CreateMultipartUpload"),
    ("GET", "/minio/health", "", False, "internal"), ("HEAD", "/bkt/a/b/c.txt", "", False, "HeadObject"),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_routes(spark):
    got = column(spark, PATHS, lambda v: route.route(F.lit("GET"), v))
    assert dict(zip(PATHS, got, strict=True)) == PATHS


def test_depth(spark):
    assert column(spark, ["/a/b/c/d", "/a/b/c"], lambda v: route.template_path(v, 3)) == ["/a/b/c/...", "/a/b/c"]


def test_route_map(spark):
    text = "# c\n\nGET /users/{id}/orders/{id}\nPOST /users/{id}\nGET /users/{id}\n*   /health\n  GET  /spaced/{x} \r\ngarbage\nGET relative\nGET /s?q={q}\n"
    patterns, rejected = route.parse_map(text)
    assert len(patterns) == 5 and rejected == 3
    paths = ["/users/7/orders/9", "/users/me", "/health", "/users/7/orders", "/other/7", "/spaced/1?token=x"]
    want = ["/users/{id}/orders/{id}", "/users/{id}", "/health", "/users/{id}/orders", "/other/{id}", "/spaced/{x}"]
    assert column(spark, paths, lambda v: route.route(F.lit("GET"), v, patterns)) == want
    deep, rejected = route.parse_map("GET" + " /x" + "/x" * 16)
    assert not deep and rejected == 1


def test_promoted_keys(spark):
    keys = ["action", "sub"]
    targets = ["/api?sub=list&action=Do&secret=x", "/api?action=41231", "/api?action", "/api?other=1", "/api?actions=x", "/api?action=" + "a" * 36, "/api?"]
    want = ["/api?action=Do&sub=list", "/api?action={id}", "/api?action=", "/api", "/api", "/api?action={id}", "/api"]
    assert column(spark, targets, lambda v: route.route(F.lit("GET"), v, keys=keys)) == want


def test_given(spark):
    assert column(spark, ["/p/{slug}", "/a\r\nb", "/" + "é" * 200], route.given) == ["/p/{slug}", "/ab", "/" + "é" * 127]


def test_redaction(spark):
    assert dict(zip(REDACTED, column(spark, REDACTED, url.redact), strict=True)) == REDACTED
    needed = column(spark, REDACTED, url.redaction_needed)
    assert needed == [k != v for k, v in REDACTED.items()]


def test_traceparent(spark):
    t, p = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"
    heads = [f"00-{t}-{p}-01", f"00-{t}-{p}-00-x", f"01-{t}-{p}-01", f"00-{'0' * 32}-{p}-01", f"00-{t}-{p}-01x", "x"]
    got = column(spark, heads, url.traceparent)
    assert [g and g["trace_flags"] for g in got] == [1, 0, None, None, None, None]


def test_basic_user(spark):
    heads = ["Basic dTpwOng=", "basic dTpw", "Basic dQ==", "Bearer dTpw", "Basic !!!", None]
    assert column(spark, heads, url.basic_user) == ["u", "u", None, None, None, None]


def test_escape(spark):
    assert column(spark, ['a\\b"c\nd'], url.label_escape) == ['a\\\\b\\"c\\nd']


def test_content_length(spark):
    assert column(spark, ["5", "5, 5", "5,6", "x", "-1"], url.content_length) == [5, 5, None, None, None]


def test_s3_operations(spark):
    df = spark.createDataFrame([(i, *o[:4]) for i, o in enumerate(OPERATIONS)], "i int, m string, p string, q string, c boolean")
    got = s3.with_operation(df, "m", "p", "q", "c").orderBy("i").collect()
    assert [r["s3_op"] for r in got] == [o[4] for o in OPERATIONS]


def test_s3_tables():
    rows = s3.operation_rows()
    assert len(rows) == 73 and len({r[4] for r in rows}) == 73 and len(set(s3.ERROR_CODES)) == 99


def test_buckets(spark):
    names = ["abc", "my.bucket-1", "ab", "A-bucket", "-abc", "a..b", "1.2.3.4", "a" * 64]
    assert column(spark, names, s3.bucket_valid) == [True, True, False, False, False, False, False, False]


def test_virtual_hosts(spark):
    hosts = ["photos.s3.example.com:9000", "my.bucket.s3.example.com", "s3.example.com", "other"]
    got = column(spark, hosts, lambda h: s3.address(h, F.lit("/2026/cat.jpg"), ("s3.example.com",)))
    assert [(g["bucket"], g["key"], g["vhost"]) for g in got] == [
        ("photos", "2026/cat.jpg", True), ("my.bucket", "2026/cat.jpg", True), ("2026", "cat.jpg", False), ("2026", "cat.jpg", False)
    ]


def test_redis_closed_set():
    known = set(redis.identities())
    assert len(known) == 395 and len(redis.WRITES) == 250
    rng = random.Random(1)
    words = [w.encode() for x in known for w in x.split("|")]
    for _ in range(20_000):
        argv = [rng.choice(words) if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(4))]
        assert redis.command(argv) in known


@pytest.mark.parametrize(
    "argv,label",
    [("get k", "GET"), ("CONFIG get x", "CONFIG|GET"), ("config zap", "CONFIG|other"), ("config", "CONFIG"), ("nope", "other"), ("", "other")],
)
def test_redis_commands(argv, label):
    assert redis.command([w.encode() for w in argv.split()]) == label


def test_redis_blocking():
    assert redis.blocking("XREAD", b"XREAD COUNT 1 BLOCK 0 STREAMS s 0".split())
    assert not redis.blocking("XREAD", b"XREAD STREAMS BLOCK 0".split())
    assert redis.blocking("BLPOP", b"BLPOP k 0".split()) and not redis.blocking("GET", b"GET k".split())


def test_redis_sessions():
    assert redis.session_effect("SELECT", b"SELECT 3".split()) == ("select", "3", None)
    assert redis.session_effect("SELECT", b"SELECT 9999".split()) == ("select", "?", None)
    assert redis.session_effect("AUTH", b"AUTH pw".split())[2] == "default"
    assert redis.session_effect("HELLO", b"HELLO 3 AUTH bob pw SETNAME x".split())[2] == "bob"
    assert redis.session_effect("AUTH", [b"AUTH", b'b"b', b"pw"])[2] == "?"


def test_redis_errors_and_secrets():
    assert redis.error_symbol(b"MOVED 1 a:1") == ("MOVED", True) and redis.error_symbol(b"wrongtype x") == ("other", False)
    assert redis.secret_arguments("AUTH", b"AUTH u p".split()) == {2}
    assert redis.secret_arguments("CONFIG|SET", b"CONFIG SET requirepass x maxmemory 1".split()) == {3}
    assert redis.secret_arguments("ACL|SETUSER", b"ACL SETUSER bob >pw on".split()) == {3}
    assert redis.secret_arguments("MIGRATE", b"MIGRATE h 1 k 0 9 AUTH2 u p".split()) == {8}


ARGVS = [
    "get k", "blpop a 0", "xread streams a 0", "XREAD block 5 STREAMS a 0", "xread streams block 0", "xreadgroup group g c block 0 streams s >", "wait 1 0", "select 3", "select 03", "select 2000", "select x", "select", "select 1 2",
    "auth pw", "auth bob pw", "auth bo'b pw", "auth a b c", "auth", "hello 3 auth bob pw", "hello 3 setname x auth ann pw", "hello 3 auth bob", "hello auth x y", "hello 3", "reset", "acl setuser bob on >pw ~* #hash", "acl setuser >x",
    "config set requirepass pw maxmemory 5", "config set maxmemory 5 masterauth pw", "config set x", "config get requirepass", "migrate h 1 k 0 5 auth pw", "migrate h 1 k 0 5 AUTH2 u pw", "migrate h 1 k 0 5 auth", "nope",
]


def test_redis_columns_agree_with_the_parser(spark):
    """What a command may wait for, does to its session and must hide: as expressions and as the parser has them."""
    df = spark.createDataFrame([(i, a.split(" ")) for i, a in enumerate(ARGVS)], "i int, a array<string>")
    a = F.col("a")
    rows = df.select("i", redis.may_block(a).alias("b"), redis.session_change(a).alias("s"), redis.secret_places(a).alias("p")).orderBy("i").collect()
    for r, text in zip(rows, ARGVS, strict=True):
        argv = [w.encode() for w in text.split(" ")]
        name = redis.command(argv)
        assert r["b"] == redis.blocking(name.split("|")[0], argv), text
        assert tuple(r["s"]) == redis.session_effect(name, argv), text
        assert set(r["p"]) == redis.secret_arguments(name, argv), text


def test_sampling_hash(spark):
    """The share is decided by xxHash64 of the start, the connection and the seed, chained as Spark chains columns."""
    import struct

    import xxhash

    from wiretally.plans import spans

    rng = random.Random(3)
    rows = [(rng.randrange(1 << 60), rng.randrange(1 << 30)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "ts_start_ns long, conn long")
    for ratio in (0.0, 0.1, 0.5, 0.999, 1.0):
        got = [r[0] for r in df.select(spans.hash_below(ratio, 7, "ts_start_ns", "conn")).collect()]
        want = []
        for ts, conn in rows:
            h = xxhash.xxh64_intdigest(struct.pack("<q", ts), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<q", conn), h)
            want.append(xxhash.xxh64_intdigest(struct.pack("<i", 7), h) < int(ratio * 2**64))
        assert got == want
