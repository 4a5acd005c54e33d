"""S3 requests: address, operation, error vocabulary and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Level, sub-resource (empty: none), method, with a copy source (None: either way), operation.
OPERATIONS = [
    ("service", "", "GET", None, "ListBuckets"),
    ("bucket", "acl", "GET", None, "GetBucketAcl"),
    ("bucket", "acl", "PUT", None, "PutBucketAcl"),
    ("bucket", "tagging", "GET", None, "GetBucketTagging"),
    ("bucket", "tagging", "PUT", None, "PutBucketTagging"),
    ("bucket", "tagging", "DELETE", None, "DeleteBucketTagging"),
    ("bucket", "policy", "GET", None, "GetBucketPolicy"),
    ("bucket", "policy", "PUT", None, "PutBucketPolicy"),
    ("bucket", "policy", "DELETE", None, "DeleteBucketPolicy"),
    ("bucket", "policyStatus", "GET", None, "GetBucketPolicyStatus"),
    ("bucket", "versioning", "GET", None, "GetBucketVersioning"),
    ("bucket", "versioning", "PUT", None, "PutBucketVersioning"),
    ("bucket", "lifecycle", "GET", None, "GetBucketLifecycleConfiguration"),
    ("bucket", "lifecycle", "PUT", None, "PutBucketLifecycleConfiguration"),
    ("bucket", "lifecycle", "DELETE", None, "DeleteBucketLifecycleConfiguration"),
    ("bucket", "location", "GET", None, "GetBucketLocation"),
    ("bucket", "notification", "GET", None, "GetBucketNotificationConfiguration"),
    ("bucket", "notification", "PUT", None, "PutBucketNotificationConfiguration"),
    ("bucket", "encryption", "GET", None, "GetBucketEncryption"),
    ("bucket", "encryption", "PUT", None, "PutBucketEncryption"),
    ("bucket", "encryption", "DELETE", None, "DeleteBucketEncryption"),
    ("bucket", "replication", "GET", None, "GetBucketReplication"),
    ("bucket", "replication", "PUT", None, "PutBucketReplication"),
    ("bucket", "replication", "DELETE", None, "DeleteBucketReplication"),
    ("bucket", "object-lock", "GET", None, "GetObjectLockConfiguration"),
    ("bucket", "object-lock", "PUT", None, "PutObjectLockConfiguration"),
    ("bucket", "cors", "GET", None, "GetBucketCors"),
    ("bucket", "cors", "PUT", None, "PutBucketCors"),
    ("bucket", "cors", "DELETE", None, "DeleteBucketCors"),
    ("bucket", "accelerate", "GET", None, "GetBucketAccelerateConfiguration"),
    ("bucket", "accelerate", "PUT", None, "PutBucketAccelerateConfiguration"),
    ("bucket", "logging", "GET", None, "GetBucketLogging"),
    ("bucket", "logging", "PUT", None, "PutBucketLogging"),
    ("bucket", "requestPayment", "GET", None, "GetBucketRequestPayment"),
    ("bucket", "requestPayment", "PUT", None, "PutBucketRequestPayment"),
    ("bucket", "website", "GET", None, "GetBucketWebsite"),
    ("bucket", "website", "PUT", None, "PutBucketWebsite"),
    ("bucket", "website", "DELETE", None, "DeleteBucketWebsite"),
    ("bucket", "publicAccessBlock", "GET", None, "GetPublicAccessBlock"),
    ("bucket", "publicAccessBlock", "PUT", None, "PutPublicAccessBlock"),
    ("bucket", "publicAccessBlock", "DELETE", None, "DeletePublicAccessBlock"),
    ("bucket", "delete", "POST", None, "DeleteObjects"),
    ("bucket", "uploads", "GET", None, "ListMultipartUploads"),
    ("bucket", "versions", "GET", None, "ListObjectVersions"),
    ("bucket", "list-type", "GET", None, "ListObjectsV2"),
    ("bucket", "", "GET", None, "ListObjects"),
    ("bucket", "", "PUT", None, "CreateBucket"),
    ("bucket", "", "DELETE", None, "DeleteBucket"),
    ("bucket", "", "HEAD", None, "HeadBucket"),
    ("bucket", "", "POST", None, "PostObject"),
    ("object", "acl", "GET", None, "GetObjectAcl"),
    ("object", "acl", "PUT", None, "PutObjectAcl"),
    ("object", "tagging", "GET", None, "GetObjectTagging"),
    ("object", "tagging", "PUT", None, "PutObjectTagging"),
    ("object", "tagging", "DELETE", None, "DeleteObjectTagging"),
    ("object", "retention", "GET", None, "GetObjectRetention"),
    ("object", "retention", "PUT", None, "PutObjectRetention"),
    ("object", "legal-hold", "GET", None, "GetObjectLegalHold"),
    ("object", "legal-hold", "PUT", None, "PutObjectLegalHold"),
    ("object", "attributes", "GET", None, "GetObjectAttributes"),
    ("object", "restore", "POST", None, "RestoreObject"),
    ("object", "select", "POST", None, "SelectObjectContent"),
    ("object", "uploads", "POST", None, "CreateMultipartUpload"),
    ("object", "uploadId", "PUT", True, "UploadPartCopy"),
    ("object", "uploadId", "PUT", False, "UploadPart"),
    ("object", "uploadId", "GET", None, "ListParts"),
    ("object", "uploadId", "POST", None, "CompleteMultipartUpload"),
    ("object", "uploadId", "DELETE", None, "AbortMultipartUpload"),
    ("object", "", "GET", None, "GetObject"),
    ("object", "", "HEAD", None, "HeadObject"),
    ("object", "", "PUT", True, "CopyObject"),
    ("object", "", "PUT", False, "PutObject"),
    ("object", "", "DELETE", None, "DeleteObject"),
]

# The error codes that may become labels.
ERROR_CODES = """
AccessDenied AccountProblem AllAccessDisabled AmbiguousGrantByEmailAddress AuthorizationHeaderMalformed
AuthorizationQueryParametersError BadDigest BadRequest BucketAlreadyExists BucketAlreadyOwnedByYou BucketNotEmpty
CredentialsNotSupported CrossLocationLoggingProhibited EntityTooLarge EntityTooSmall ExpiredToken
IllegalVersioningConfigurationException IncompleteBody IncorrectNumberOfFilesInPostRequest InlineDataTooLarge InternalError
InvalidAccessKeyId InvalidAddressingHeader InvalidArgument InvalidBucketName InvalidBucketState InvalidDigest
InvalidEncryptionAlgorithmError InvalidLocationConstraint InvalidObjectState InvalidPart InvalidPartOrder InvalidPayer
InvalidPolicyDocument InvalidRange InvalidRequest InvalidSOAPRequest InvalidSecurity InvalidStorageClass
InvalidTargetBucketForLogging InvalidToken InvalidURI InvalidWriteOffset KeyTooLongError MalformedACLError MalformedPOSTRequest
MalformedXML MaxMessageLengthExceeded MaxPostPreDataLengthExceededError MetadataTooLarge MethodNotAllowed MissingAttachment
MissingContentLength MissingRequestBodyError MissingSecurityElement MissingSecurityHeader NoLoggingStatusForKey
NoSuchAccessPoint NoSuchBucket NoSuchBucketPolicy NoSuchCORSConfiguration NoSuchKey NoSuchLifecycleConfiguration
NoSuchObjectLockConfiguration NoSuchTagSet NoSuchUpload NoSuchVersion NoSuchWebsiteConfiguration NotImplemented NotSignedUp
ObjectLockConfigurationNotFoundError OperationAborted PermanentRedirect PreconditionFailed Redirect
ReplicationConfigurationNotFoundError RequestHeaderSectionTooLarge RequestIsNotMultiPartContent RequestTimeTooSkewed
RequestTimeout RequestTorrentOfBucketError RestoreAlreadyInProgress ServerSideEncryptionConfigurationNotFoundError
ServiceUnavailable SignatureDoesNotMatch SlowDown TemporaryRedirect TokenRefreshRequired TooManyBuckets TooManyParts
UnexpectedContent UnresolvableGrantByEmailAddress UserKeyMustBeSpecified XAmzContentSHA256Mismatch XMinioInvalidObjectName
XMinioMalformedIAMPolicy XMinioObjectExistsAsDirectory XMinioServerNotInitialized XMinioStorageFull
""".split()

#: Paths of the server's own interface, path-style only.
INTERNAL_PREFIX = "/minio"


def operation_rows() -> list[tuple[str, str, str, bool | None, str]]:
    """(level, sub-resource or empty, method, copy, operation); copy None: either."""
    return OPERATIONS


SUBRESOURCES = tuple(sorted({r[1] for r in operation_rows()} - {""}))


def operation_table(spark: SparkSession) -> DataFrame:
    """t_level, t_sub, t_method, t_copy (both values spelled out), t_op: a fixed table, to be broadcast."""
    rows = [(a, b, m, c, n) for a, b, m, copy, n in operation_rows() for c in ((True, False) if copy is None else (copy,))]
    return spark.createDataFrame(rows, "t_level string, t_sub string, t_method string, t_copy boolean, t_op string")


def bucket_valid(name: Column) -> Column:
    """3 to 63 of a-z, 0-9, dot and hyphen; letter or digit at both ends; no two dots in a row; not four dotted numbers."""
    return name.rlike("^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$") & ~name.contains("..") & ~name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")


def address(host: Column, path: Column, domains: tuple[str, ...] = ()) -> Column:
    """struct(bucket, key, vhost, valid, internal): by a configured host suffix the whole prefix is the bucket and the path the
    key, else the first path segment is the bucket."""
    name = F.regexp_replace(F.coalesce(host, F.lit("")), ":[0-9]+$", "")
    prefix = F.lit(None).cast("string")
    for d in domains:
        prefix = F.coalesce(prefix, F.when(name.endswith("." + d), F.substring(name, F.lit(1), F.length(name) - len(d) - 1)))
    vhost = prefix.isNotNull()
    tail = F.regexp_replace(F.coalesce(path, F.lit("")), "^/", "")
    bucket = F.when(vhost, prefix).otherwise(F.substring_index(tail, "/", 1))
    key = F.when(vhost, tail).otherwise(F.when(F.instr(tail, "/") > 0, F.substring(tail, F.instr(tail, "/") + 1, F.length(tail))).otherwise(""))
    internal = ~vhost & (path.startswith(INTERNAL_PREFIX + "/") | (path == INTERNAL_PREFIX))
    return F.struct(bucket.alias("bucket"), key.alias("key"), vhost.alias("vhost"), bucket_valid(bucket).alias("valid"), F.coalesce(internal, F.lit(False)).alias("internal"))


def subresource(query: Column) -> Column:
    """The first recognised key of a query; list-type only with the value 2."""
    pairs = F.split(F.coalesce(query, F.lit("")), "&")

    def known(p: Column) -> Column:
        k = F.substring_index(p, "=", 1)
        return k.isin(*(s for s in SUBRESOURCES if s != "list-type")) | (p == "list-type=2")

    return F.coalesce(F.substring_index(F.get(F.filter(pairs, known), F.lit(0)), "=", 1), F.lit(""))


def with_operation(df: DataFrame, method: str, path: str, query: str, copy: str, host: str | None = None, domains: tuple[str, ...] = ()) -> DataFrame:
    """df with s3_op: a lookup in the fixed table by level, sub-resource, method and copy source; other if it has no row."""
    a = address(F.col(host) if host else F.lit(None).cast("string"), F.col(path), domains)
    out = df.withColumn("_a", a).withColumn("_sub", subresource(F.col(query)))
    level = F.when(F.col("_a.bucket") == "", "service").when(F.col("_a.key") == "", "bucket").otherwise("object")
    out = out.withColumn("_level", level)
    t = F.broadcast(operation_table(df.sparkSession))
    pairs = (("_level", "t_level"), ("_sub", "t_sub"), (method, "t_method"), (copy, "t_copy"))
    on = [F.col(a) == F.col(b) for a, b in pairs]
    out = out.join(t, on, "left")
    op = F.when(F.col("_a.internal"), "internal").otherwise(F.coalesce("t_op", F.lit("other")))
    return out.select(*df.columns, op.alias("s3_op"))


def known_code(code: Column) -> Column:
    return F.when(code.isin(*ERROR_CODES), code).otherwise("other")


def error_code(body: Column) -> Column:
    """The text of the first Code element, folded to the known codes; null without one."""
    code = F.regexp_extract(body, "<Code>(.*?)</Code>", 1)
    return F.when(code != "", known_code(code))


def access_key(authorization: Column, query: Column) -> Column:
    """The access key of a signed or presigned request, - for an anonymous one."""
    v4 = F.regexp_extract(authorization, "Credential=([^/,]+)", 1)
    v2 = F.regexp_extract(authorization, "^AWS ([^:]+):", 1)
    signed = F.regexp_extract(query, "(?:^|&)X-Amz-Credential=(.*?)(?:/|%2[Ff]|&|$)", 1)
    found = [F.nullif(x, F.lit("")) for x in (v4, v2, signed)]
    return F.coalesce(*found, F.lit("-"))
