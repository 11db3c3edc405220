"""Names, hashes, keys and schedules as column expressions; nothing here is a user function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format and of the naming scheme.
ERROR_CHARS = 500
PER_MILLISECOND = 256
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def shard_id(value: Column, bits: int) -> Column:
    """The top ``bits`` of the SHA-256 of the UTF-8 text: a long for up to 62 bits, a string of binary digits beyond."""
    if not 1 <= bits <= 256:
        raise ValueError("bits must be in 1..256")
    digest = F.sha2(value.cast("string").cast("binary"), 256)
    if bits <= 32:
        return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits)
    if bits <= 62:
        high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        low = F.shiftright(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"), 64 - bits)
        return F.shiftleft(high, bits - 32).bitwiseOR(low)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(8)])
    return F.substring(digits, 1, bits)


def shard_count(bits: Column | int) -> Column:
    return F.shiftleft(F.lit(1), bits) if isinstance(bits, int) else F.expr("1").cast("int") * F.pow(F.lit(2), bits).cast("int")


def source_shard(key: Column | None, s3_key: Column, bits: int) -> Column:
    """Shard of a source row: by the configured column where it has a value, else by its object key."""
    return shard_id(s3_key.cast("string") if key is None else F.coalesce(key.cast("string"), s3_key.cast("string")), bits)


def worker_of(shard: Column, workers: int) -> Column:
    if workers <= 0:
        raise ValueError("workers must be positive")
    return F.pmod(shard, F.lit(workers))


def hash_hex(value: Column) -> Column:
    return F.sha2(value.cast("string").cast("binary"), 256)


def marker_shard(value: Column) -> Column:
    """First byte of the hash, whatever the number of shard bits."""
    return F.conv(F.substring(hash_hex(value), 1, 2), 16, 10).cast("int")


def checksum_byte(f48: Column) -> Column:
    """Sum of the six bytes, modulo 256."""
    parts = [F.shiftright(f48, 8 * k).bitwiseAND(255) for k in range(6)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.pmod(total, F.lit(256))


def f48(ms: Column, node: Column | int, seq: Column, wrap_bits: int = 32) -> Column:
    if not 1 <= wrap_bits <= 32:
        raise ValueError("wrap_bits must be in 1..32")
    node = F.lit(node) if isinstance(node, int) else node
    return F.shiftleft(ms.cast("long").bitwiseAND((1 << wrap_bits) - 1), 16).bitwiseOR(F.shiftleft(node.cast("long"), 8)).bitwiseOR(seq.cast("long"))


def snowflake_name(prefix: Column | str, day: Column, f: Column) -> Column:
    """``<prefix>_YYYYMMDD_(F12_CC)`` with the 48-bit value and its checksum in upper-case hex."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit("_("), F.lpad(F.hex(f), 12, "0"), F.lit("_"), F.lpad(F.hex(checksum_byte(f)), 2, "0"), F.lit(")"))


def parse_day(name: Column) -> Column:
    """Day in the first ``_(8 digits)_`` of a name; null where there is none or it is no day of the calendar."""
    digits = F.nullif(F.regexp_extract(name, "_([0-9]{8})_", 1), F.lit(""))
    return F.try_to_date(digits, "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def hash_byte(name: Column, hash_text: Column | None = None, parameter: Column | None = None) -> Column:
    """Byte that routes a request: the explicit parameter (0x, 0o, 0b or decimal, any sign), else the first two hex digits given, else those of the name's hash. A parameter or hash that cannot be read gives null: a bad request."""
    out = F.conv(F.substring(hash_hex(name), 1, 2), 16, 10).cast("int")
    if hash_text is not None:
        out = F.when(hash_text.isNull(), out).when(hash_text.rlike("^[0-9A-Fa-f]{2}"), F.conv(F.substring(hash_text, 1, 2), 16, 10).cast("int"))
    if parameter is not None:
        p = F.lower(F.trim(parameter))
        sign, body = F.when(p.startswith("-"), -1).otherwise(1), F.regexp_replace(p, "^[+-]", "")
        based = lambda prefix, digits, base: F.when(body.rlike(f"^{prefix}[{digits}]+$"), F.conv(F.substring(body, 3, 16), base, 10).try_cast("int"))
        value = F.coalesce(based("0x", "0-9a-f", 16), based("0o", "0-7", 8), based("0b", "01", 2), body.try_cast("int")) * sign
        out = F.when(parameter.isNull(), out).otherwise(value)
    return out


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def parent_prefix(key: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.when(F.instr(key, "/") > 0, F.regexp_extract(key, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def full_key(key: Column, prefix: str | None) -> Column:
    """The key under the prefix, unless it is there already."""
    if not prefix:
        return key
    p = prefix.rstrip("/")
    return F.when(key.startswith(p + "/"), key).otherwise(F.concat(F.lit(p + "/"), F.regexp_replace(key, "^/+", "")))


def upload_key(key: Column, prefix: str | None) -> Column:
    """Prefix and key joined by one slash, always."""
    bare = F.regexp_replace(key, "^/+", "")
    return F.concat(F.lit(prefix.rstrip("/") + "/"), bare) if prefix else key


def container_key(prefix: str, day: Column, shard: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/shard_"), F.format_string("%02d", shard), F.lit(".des"))


def shard_hex(shard: Column, bits: int) -> Column:
    """Lower-case hex of a fixed width."""
    return F.lower(F.lpad(F.hex(shard), -(-bits // 4), "0"))


def external_key(prefix: Column | str, name: Column) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(F.when(F.length(p) > 0, F.concat(F.rtrim(p, F.lit("/")), F.lit("/"))).otherwise(F.lit("")), F.lit("_bigFiles/"), name)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def table_name(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(schema, F.lit("")), name)


def dotted_extension(ext: Column) -> Column:
    return F.when((ext.isNull()) | (ext == ""), F.lit("")).when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))


def ordinal(host: Column) -> Column:
    """Number after the last dash of a host name; null without one."""
    return F.nullif(F.regexp_extract(host, "-([0-9]+)$", 1), F.lit("")).cast("int")


def truncated(text: Column, chars: int = ERROR_CHARS) -> Column:
    return F.substring(text, 1, chars)


def retry_wait(attempt: Column, base: float = 2.0, jitter: Column | None = None) -> Column:
    """Wait before the next attempt, attempts counted from one; jitter is a factor."""
    wait = F.pow(F.lit(base), attempt.cast("double"))
    return wait if jitter is None else wait * jitter


def attempts_made(limit: Column) -> Column:
    """Even a limit of none makes one call."""
    return F.greatest(limit, F.lit(1))


def router_wait(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(3.0))


def human_size(size: Column) -> Column:
    """Steps of 1024 and one decimal; ties, which are exact here, go to the even digit."""
    s, out = size.cast("double"), None
    for i, unit in enumerate(SIZE_UNITS):
        text = F.format_string("%.1f" + unit, F.bround(s / float(1024**i), 1))
        if i == len(SIZE_UNITS) - 1:
            out = out.otherwise(text)
        else:
            hit = s < float(1024 ** (i + 1))
            out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def local_cache_key(path: Column, size: Column, mtime: Column, version: int = 1) -> Column:
    # Fixed value: the key's first field.
    return F.concat_ws(":", F.lit("DES"), path, size.cast("string"), mtime.cast("string"), F.lit(str(version)))


def remote_cache_key(bucket: Column, key: Column, etag: Column) -> Column:
    return F.concat_ws("/", bucket, key, etag)


def flag_labels(flags: Column) -> Column:
    """Names of the set flags, comma-joined; the deletion flag is not shown."""
    names = (("EXTERNAL", 1), ("COMPRESSED", 2), ("ENCRYPTED", 4))
    return F.array_join(F.filter(F.array(*[F.when(flags.bitwiseAND(v) != 0, F.lit(n)) for n, v in names]), lambda x: x.isNotNull()), ",")


def crc_layout(key: Column, bits: int) -> Column:
    """The textual alternative layout: CRC32 masked to the shard bits."""
    return F.crc32(key.cast("string").cast("binary")).bitwiseAND((1 << bits) - 1)


# URL drivers and default ports by dialect.
JDBC_SCHEMES = {"postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mssql": "sqlserver", "oracle": "oracle:thin"}
