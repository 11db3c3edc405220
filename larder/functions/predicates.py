"""Predicates of the archive and its control plane as Boolean columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format and of the error classes.
EXTERNAL, COMPRESSED, ENCRYPTED, DELETED = 1, 2, 4, 8
BIG_FILE = 100 * 1024 * 1024
NAME_BYTES = 65535
FORBIDDEN = '[/\\\\:*?"<>|]'
RETRYABLE_WORDS = ("timeout", "connection", "deadlock", "lock", "temporary")
RETRYABLE_STATES = ("40P01", "55P03", "40001")
RETRYABLE_DB_MARKS = ("deadlock detected", "could not obtain lock", "lock wait timeout", "timeout expired", "could not serialize access", "serialization failure", "database is locked")
RETRYABLE_STATUS = (500, 503)
RETRYABLE_CODES = ("500", "503", "429", "REQUESTTIMEOUT", "TOOMANYREQUESTS")


def valid_name(name: Column) -> Column:
    """Not empty, not longer than the name field holds, none of the forbidden characters."""
    return F.coalesce((F.octet_length(name) > 0) & (F.octet_length(name) <= NAME_BYTES) & ~name.rlike(FORBIDDEN), F.lit(False))


def externalise(size: Column, forced: Column | None = None, threshold: int = BIG_FILE, storage: bool = True) -> Column:
    big = size >= threshold
    return (big if forced is None else big | forced) & F.lit(storage)


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(flag) != 0


def is_external(flags: Column) -> Column:
    return has_flag(flags, EXTERNAL)


def mark_candidate_legacy(created: Column, status: Column, name: Column, digest: Column, shard: Column, cutoff: Column) -> Column:
    return (created <= cutoff) & (status.isNull() | (status != "DES_TODO")) & (name.isNull() | digest.isNull() | shard.isNull())


def mark_candidate(created: Column, status: Column, name: Column, cutoff: Column, exclude_failed: bool = False) -> Column:
    """Rows to mark; failed rows without a name are selected again unless excluded."""
    out = (created <= cutoff) & (status.isNull() | (status == "retry") | name.isNull())
    return out & ~F.coalesce(status == "failed", F.lit(False)) if exclude_failed else out


def stale_claim(status: Column, claimed_at: Column, cutoff: Column) -> Column:
    return (status == "claimed") & (claimed_at.isNull() | (claimed_at < cutoff))


def expired_lock(expires_at: Column, now: Column) -> Column:
    return expires_at < now


def stuck_container(status: Column, created: Column, cutoff: Column) -> Column:
    return (status == "writing") & (created < cutoff)


def _any_of(message: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def retryable(message: Column) -> Column:
    return _any_of(message, RETRYABLE_WORDS)


def retryable_db(state: Column, message: Column) -> Column:
    return F.coalesce(state.isin(*RETRYABLE_STATES), F.lit(False)) | _any_of(message, RETRYABLE_DB_MARKS)


def retryable_store(status: Column, code: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE_STATUS), F.lit(False)) | F.coalesce(F.upper(code).isin(*RETRYABLE_CODES), F.lit(False))


_PLAIN, _DOTTED = "^[A-Za-z_][A-Za-z0-9_]*$", "^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$"


def safe_identifier(name: Column, dotted: bool = False) -> Column:
    return F.coalesce(name.rlike(_DOTTED if dotted else _PLAIN), F.lit(False))


def check_identifier(name: str, dotted: bool = False) -> str:
    """The name, or an error if it may not stand in a statement."""
    if not re.match(_DOTTED if dotted else _PLAIN, name):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


def valid_prefix(prefix: Column) -> Column:
    return F.coalesce(prefix.rlike("^[A-Za-z0-9]+$"), F.lit(False))


def valid_naming(prefix: str, node_id: int, wrap_bits: int = 32) -> None:
    if not re.fullmatch("[A-Za-z0-9]+", prefix or ""):
        raise ValueError("prefix must be ASCII letters and digits")
    if not 0 <= node_id <= 255:
        raise ValueError("node_id must be in 0..255")
    if not 1 <= wrap_bits <= 32:
        raise ValueError("wrap_bits must be in 1..32")


def unresolved(resolved: Column) -> Column:
    return ~F.coalesce(resolved, F.lit(False))
