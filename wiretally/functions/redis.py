"""Redis commands: identity, session effects, errors and what must never be kept of their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of commands that change data.
WRITING = """
APPEND BITFIELD BITOP BLMOVE BLMPOP BLPOP BRPOP BRPOPLPUSH BZMPOP BZPOPMAX BZPOPMIN COPY DECR DECRBY DEL EXPIRE EXPIREAT FLUSHALL
FLUSHDB GEOADD GEORADIUS GEORADIUSBYMEMBER GEOSEARCHSTORE GETDEL GETEX GETSET HDEL HEXPIRE HEXPIREAT HINCRBY HINCRBYFLOAT HMSET
HPERSIST HPEXPIRE HPEXPIREAT HSET HSETNX INCR INCRBY INCRBYFLOAT LINSERT LMOVE LMPOP LPOP LPUSH LPUSHX LREM LSET LTRIM MIGRATE
MOVE MSET MSETNX PERSIST PEXPIRE PEXPIREAT PFADD PFDEBUG PFMERGE PSETEX RENAME RENAMENX RESTORE RESTORE-ASKING RPOP RPOPLPUSH
RPUSH RPUSHX SADD SDIFFSTORE SET SETBIT SETEX SETNX SETRANGE SINTERSTORE SMOVE SORT SPOP SREM SUNIONSTORE SWAPDB UNLINK XACK XADD
XAUTOCLAIM XCLAIM XDEL XREADGROUP XSETID XTRIM ZADD ZDIFFSTORE ZINCRBY ZINTERSTORE ZMPOP ZPOPMAX ZPOPMIN ZRANGESTORE ZREM
ZREMRANGEBYLEX ZREMRANGEBYRANK ZREMRANGEBYSCORE ZUNIONSTORE
""".split()

# The names of all other commands.
READING = """
ACL ASKING AUTH BGREWRITEAOF BGSAVE BITCOUNT BITFIELD_RO BITPOS CLIENT CLUSTER COMMAND CONFIG DBSIZE DEBUG DISCARD DUMP ECHO EVAL
EVALSHA EVALSHA_RO EVAL_RO EXEC EXISTS EXPIRETIME FAILOVER FCALL FCALL_RO FUNCTION GEODIST GEOHASH GEOPOS GEORADIUSBYMEMBER_RO
GEORADIUS_RO GEOSEARCH GET GETBIT GETRANGE HELLO HEXISTS HEXPIRETIME HGET HGETALL HKEYS HLEN HMGET HPEXPIRETIME HPTTL HRANDFIELD
HSCAN HSTRLEN HTTL HVALS INFO KEYS LASTSAVE LATENCY LCS LINDEX LLEN LOLWUT LPOS LRANGE MEMORY MGET MODULE MONITOR MULTI OBJECT
PEXPIRETIME PFCOUNT PFSELFTEST PING PSUBSCRIBE PSYNC PTTL PUBLISH PUBSUB PUNSUBSCRIBE QUIT RANDOMKEY READONLY READWRITE REPLCONF
REPLICAOF RESET ROLE SAVE SCAN SCARD SCRIPT SDIFF SELECT SHUTDOWN SINTER SINTERCARD SISMEMBER SLAVEOF SLOWLOG SMEMBERS SMISMEMBER
SORT_RO SPUBLISH SRANDMEMBER SSCAN SSUBSCRIBE STRLEN SUBSCRIBE SUBSTR SUNION SUNSUBSCRIBE SYNC TIME TOUCH TTL TYPE UNSUBSCRIBE
UNWATCH WAIT WAITAOF WATCH XGROUP XINFO XLEN XPENDING XRANGE XREAD XREVRANGE ZCARD ZCOUNT ZDIFF ZINTER ZINTERCARD ZLEXCOUNT
ZMSCORE ZRANDMEMBER ZRANGE ZRANGEBYLEX ZRANGEBYSCORE ZRANK ZREVRANGE ZREVRANGEBYLEX ZREVRANGEBYSCORE ZREVRANK ZSCAN ZSCORE ZUNION
""".split()

# Commands whose second word is a command of its own.
SUBCOMMANDS = {
    "ACL": "CAT DELUSER DRYRUN GENPASS GETUSER HELP LIST LOAD LOG SAVE SETUSER USERS WHOAMI",
    "CLIENT": "CACHING GETNAME GETREDIR HELP ID INFO KILL LIST NO-EVICT NO-TOUCH PAUSE REPLY SETINFO SETNAME TRACKING TRACKINGINFO"
    " UNBLOCK UNPAUSE",
    "CLUSTER": "ADDSLOTS ADDSLOTSRANGE BUMPEPOCH COUNT-FAILURE-REPORTS COUNTKEYSINSLOT DELSLOTS DELSLOTSRANGE FAILOVER FLUSHSLOTS"
    " FORGET GETKEYSINSLOT HELP INFO KEYSLOT LINKS MEET MYID MYSHARDID NODES REPLICAS REPLICATE RESET SAVECONFIG SET-CONFIG-EPOCH"
    " SETSLOT SHARDS SLAVES SLOTS",
    "COMMAND": "COUNT DOCS GETKEYS GETKEYSANDFLAGS HELP INFO LIST",
    "CONFIG": "GET HELP RESETSTAT REWRITE SET",
    "FUNCTION": "DELETE DUMP FLUSH HELP KILL LIST LOAD RESTORE STATS",
    "LATENCY": "DOCTOR GRAPH HELP HISTOGRAM HISTORY LATEST RESET",
    "MEMORY": "DOCTOR HELP MALLOC-STATS PURGE STATS USAGE",
    "MODULE": "HELP LIST LOAD LOADEX UNLOAD",
    "OBJECT": "ENCODING FREQ HELP IDLETIME REFCOUNT",
    "PUBSUB": "CHANNELS HELP NUMPAT NUMSUB SHARDCHANNELS SHARDNUMSUB",
    "SCRIPT": "DEBUG EXISTS FLUSH HELP KILL LOAD",
    "SLOWLOG": "GET HELP LEN RESET",
    "XGROUP": "CREATE CREATECONSUMER DELCONSUMER DESTROY HELP SETID",
    "XINFO": "CONSUMERS GROUPS HELP STREAM",
}

# Error symbols that may become labels; the first two are redirects.
REDIRECTS = ("ASK", "MOVED")
ERRORS = (
    *REDIRECTS, "BUSY", "BUSYGROUP", "CLUSTERDOWN", "CROSSSLOT", "ERR", "EXECABORT", "LOADING", "MASTERDOWN", "MISCONF", "NOAUTH",
    "NOGOODSLAVE", "NOPERM", "NOPROTO", "NOREPLICAS", "NOSCRIPT", "NOTBUSY", "OOM", "READONLY", "TRYAGAIN", "UNBLOCKED",
    "WRONGPASS", "WRONGTYPE",
)
# Commands that may wait on the server.
BLOCKING = (
    "BLMOVE", "BLMPOP", "BLPOP", "BRPOP", "BRPOPLPUSH", "BZMPOP", "BZPOPMAX", "BZPOPMIN", "WAIT", "WAITAOF", "XREAD", "XREADGROUP"
)
SUBSCRIBES = ("PSUBSCRIBE", "SSUBSCRIBE", "SUBSCRIBE")
UNSUBSCRIBES = ("PUNSUBSCRIBE", "SUNSUBSCRIBE", "UNSUBSCRIBE")
REPLICATION = ("PSYNC", "REPLCONF", "SYNC")
MOST_DB = 1024
SECRET_PARAMETERS = ("pass", "auth", "secret")


#: name -> whether it writes
WRITES = {x: x in WRITING for x in sorted(WRITING + READING)}
CONTAINERS = {c: frozenset(s.split()) for c, s in SUBCOMMANDS.items()}


def identities() -> list[str]:
    """The closed set of command labels."""
    subs = [f"{c}|{s}" for c, names in CONTAINERS.items() for s in sorted(names)]
    return [*sorted(WRITES), *subs, *(f"{c}|other" for c in CONTAINERS), "other"]


def command(argv: list[bytes]) -> str:
    """The label of a command: never anything that isn't in identities()."""
    name = upper(argv[0]) if argv else ""
    if name in CONTAINERS and len(argv) > 1:
        sub = upper(argv[1])
        return f"{name}|{sub}" if sub in CONTAINERS[name] else f"{name}|other"
    return name if name in WRITES else "other"


def upper(word: bytes) -> str:
    return word[:64].upper().decode("latin-1")


def blocking(name: str, argv: list[bytes]) -> bool:
    """Whether the command may wait: XREAD only with BLOCK before STREAMS."""
    if name not in BLOCKING:
        return False
    if not name.startswith("XREAD"):
        return True
    words = [upper(a) for a in argv[1:]]
    streams = words.index("STREAMS") if "STREAMS" in words else len(words)
    return "BLOCK" in words[:streams]


def session_effect(name: str, argv: list[bytes]) -> tuple[str, str | None, str | None]:
    """(kind, db, user) of what a command does to its session once it succeeds; kind empty: nothing."""
    if name == "SELECT" and len(argv) == 2:
        return "select", parse_db(argv[1]), None
    if name == "AUTH":
        return "auth", None, user_name(argv[1]) if len(argv) == 3 else "default"
    if name == "HELLO":
        words = [upper(a) for a in argv]
        if "AUTH" in words[2:] and words.index("AUTH", 2) + 2 < len(argv):
            return "auth", None, user_name(argv[words.index("AUTH", 2) + 1])
    if name == "RESET":
        return "reset", "0", "default"
    return "", None, None


def parse_db(word: bytes) -> str:
    return str(int(word)) if word.isdigit() and len(word) <= 4 and int(word) <= MOST_DB else "?"


def user_name(word: bytes) -> str:
    ok = 0 < len(word) <= 63 and all(0x20 < c < 0x7F and c not in b"\"'\\" for c in word)
    return word.decode() if ok else "?"


def error_symbol(line: bytes) -> tuple[str, bool]:
    """(label, redirect) of an error line without its type byte: exact symbols, in upper case, else other."""
    word = line.split(b" ", 1)[0].split(b"\r", 1)[0].decode("latin-1")
    return (word, word in REDIRECTS) if word in ERRORS else ("other", False)


def secret_arguments(name: str, argv: list[bytes]) -> set[int]:
    """Places of arguments that must be blanked wherever a command is shown."""
    n, words = len(argv), [upper(a) for a in argv]
    if name == "AUTH":
        return {n - 1} if n > 1 else set()
    if name == "HELLO" and "AUTH" in words:
        return {words.index("AUTH") + 2} & set(range(n))
    if name == "ACL|SETUSER":
        return {i for i in range(3, n) if argv[i][:1] in b"><#!" and argv[i][:1]}
    if name == "CONFIG|SET":
        return {i + 1 for i in range(2, n - 1, 2) if any(s in argv[i].lower().decode("latin-1") for s in SECRET_PARAMETERS)}
    if name == "MIGRATE":
        out = {words.index("AUTH") + 1} if "AUTH" in words else set()
        return (out | ({words.index("AUTH2") + 2} if "AUTH2" in words else set())) & set(range(n))
    return set()


def command_table(spark: SparkSession) -> DataFrame:
    """label, writes, blocking: the closed set as a fixed table."""
    rows = [(x, WRITES.get(x.split("|")[0], False), x in BLOCKING) for x in identities()]
    return spark.createDataFrame(rows, "label string, writes boolean, blocking boolean")


def command_label(argv: Column) -> Column:
    """The label of an array of words, as an expression over the fixed names."""
    name, sub = F.upper(F.get(argv, F.lit(0))), F.upper(F.get(argv, F.lit(1)))
    known = F.array(*(F.lit(x) for x in identities()))
    pair = F.concat(name, F.lit("|"), sub)
    held = name.isin(*CONTAINERS) & sub.isNotNull()
    nested = F.when(F.array_contains(known, pair), pair).otherwise(F.concat(name, F.lit("|other")))
    return F.when(held, nested).when(name.isin(*WRITES), name).otherwise("other")


def error_label(line: Column) -> Column:
    word = F.substring_index(line, " ", 1)
    return F.when(word.isin(*ERRORS), word).otherwise("other")


def shown(label: Column, argc: Column) -> Column:
    """A command as it may be shown: its words, and a mark for each argument, at most 32."""
    marks = F.greatest(F.least(argc, F.lit(32)), F.lit(0)).cast("int")
    return F.concat(F.replace(label, F.lit("|"), F.lit(" ")), F.repeat(F.lit(" ?"), marks), F.when(argc > 32, " ...").otherwise(""))


def words_of(argv: Column) -> Column:
    return F.transform(argv, F.upper)


def may_block(argv: Column) -> Column:
    """Whether a command may wait on the server; XREAD and its kin only with BLOCK before STREAMS."""
    words = words_of(argv)
    name = F.get(words, F.lit(0))
    stop = F.array_position(words, "STREAMS")
    block = F.array_position(words, "BLOCK")
    asks = (block > 1) & ((stop == 0) | (block < stop))
    return F.coalesce(name.isin(*BLOCKING) & (~name.startswith("XREAD") | asks), F.lit(False))


def session_change(argv: Column) -> Column:
    """struct(kind, db, user): what a command does to its session once it succeeds; kind empty: nothing."""
    words, n = words_of(argv), F.size(argv)
    name = F.get(words, F.lit(0))
    word = lambda i: F.get(argv, i)
    at = F.array_position(F.slice(words, 3, MOST_DB), "AUTH").cast("int")  # 1: the third word

    def user(x: Column) -> Column:
        return F.when(x.rlike(r"^[!#-&(-\[\]-~]{1,63}$"), x).otherwise("?")

    number = word(F.lit(1))
    db = F.when(number.rlike("^[0-9]{1,4}$") & (number.try_cast("int") <= MOST_DB), number.try_cast("int").cast("string")).otherwise("?")
    change = lambda kind, d, u: F.struct(F.lit(kind).alias("kind"), d.cast("string").alias("db"), u.cast("string").alias("user"))
    none = F.lit(None)
    return (
        F.when((name == "SELECT") & (n == 2), change("select", db, none))
        .when(name == "AUTH", change("auth", none, F.when(n == 3, user(word(F.lit(1)))).otherwise("default")))
        .when((name == "HELLO") & (at > 0) & (at + 3 < n), change("auth", none, user(word(at + 2))))
        .when(name == "RESET", change("reset", F.lit("0"), F.lit("default")))
        .otherwise(change("", none, none))
    )


def secret_places(argv: Column) -> Column:
    """Places of arguments that must be blanked wherever a command is shown, ascending."""
    words, n = words_of(argv), F.size(argv)
    name, sub = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    after = lambda word, k: F.when(F.array_position(words, word) > 0, F.array((F.array_position(words, word) - 1 + k).cast("int"))).otherwise(F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    marked = F.filter(every, lambda i: (i >= 3) & F.substring(F.get(argv, i), 1, 1).isin(">", "<", "#", "!"))
    secret = lambda i: F.lower(F.get(argv, i - 1)).rlike("|".join(SECRET_PARAMETERS))
    values = F.filter(every, lambda i: (i >= 3) & (i % 2 == 1) & secret(i))
    found = (
        F.when((name == "AUTH") & (n > 1), F.array(n - 1))
        .when(name == "HELLO", after("AUTH", 2))
        .when((name == "ACL") & (sub == "SETUSER"), marked)
        .when((name == "CONFIG") & (sub == "SET"), values)
        .when(name == "MIGRATE", F.array_sort(F.array_distinct(F.concat(after("AUTH", 1), after("AUTH2", 2)))))
        .otherwise(F.array().cast("array<int>"))
    )
    return F.filter(found, lambda i: (i >= 0) & (i < n))
