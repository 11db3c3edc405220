"""Source configuration: typed, checked, and turned into JDBC options."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession

DIALECTS = ("postgres", "mysql", "mariadb", "mssql", "oracle")
# Class names of the public JDBC drivers.
DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mariadb": "org.mariadb.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver"}


def _between(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in {low}..{high}")


@dataclass(frozen=True)
class Connection:
    type: str
    host: str
    port: int
    database: str
    username: str
    password: str = field(repr=False, default="")
    charset: str | None = None
    pool_size: int = 5

    def __post_init__(self):
        if self.type not in DIALECTS:
            raise ValueError(f"unknown database type {self.type!r}")
        _between("port", self.port, 1, 65535)
        _between("pool_size", self.pool_size, 1, 100)

    def url(self) -> str:
        """The JDBC URL of the dialect."""
        at = f"{self.host}:{self.port}"
        if self.type == "oracle":
            return f"jdbc:oracle:thin:@//{at}/{self.database}"
        if self.type == "mssql":
            return f"jdbc:sqlserver://{at};databaseName={self.database}"
        if self.type in ("mysql", "mariadb"):
            return f"jdbc:{self.type}://{at}/{self.database}?characterEncoding={quote(self.charset or 'utf8mb4')}"
        return f"jdbc:postgresql://{at}/{self.database}"


@dataclass(frozen=True)
class Mapping:
    id: str
    s3_bucket: str
    s3_key: str
    size_bytes: str
    status: str | None = None
    created_at: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    name: str
    connection: Connection
    table: str
    mapping: Mapping
    schema: str | None = None
    where: str | None = None
    shard_key: str | None = None
    shard_bits: int = 8
    batch_size: int = 100
    enabled: bool = True
    pending: str = "pending"
    claimed: str = "claimed"

    def __post_init__(self):
        if not self.name or not self.table:
            raise ValueError("a source needs a name and a table")
        _between("shard_bits", self.shard_bits, 1, 16)
        _between("batch_size", self.batch_size, 1, 10_000)

    @property
    def full_table(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table

    @property
    def shard_count(self) -> int:
        return 1 << self.shard_bits

    def query(self, status: str | None = None, before: str | None = None, limit: int | None = None) -> str:
        """The rows to read as a subquery, so that the database filters them: the source's own condition, a status, created before a time (ISO), the first by id."""
        m = self.mapping
        quoted = lambda text: "'" + text.replace("'", "''") + "'"
        tests = [f"({self.where})"] if self.where else []
        if status is not None and m.status:
            tests.append(f"{m.status} = {quoted(status)}")
        if before is not None and m.created_at:
            tests.append(f"{m.created_at} <= {quoted(before)}")
        text = f"SELECT * FROM {self.full_table}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
        if limit is not None:
            text += f" ORDER BY {m.id} OFFSET 0 ROWS FETCH NEXT {int(limit)} ROWS ONLY" if self.connection.type in ("mssql", "oracle") else f" ORDER BY {m.id} LIMIT {int(limit)}"
        return f"({text}) source_rows"

    def options(self, status: str | None = None, before: str | None = None, limit: int | None = None, low: int | None = None, high: int | None = None, parts: int = 16, driver: str | None = None) -> dict[str, str]:
        """The options of Spark's JDBC reader."""
        at = self.connection
        out = {"url": at.url(), "dbtable": self.query(status, before, limit), "user": at.username, "password": at.password, "driver": driver or DRIVERS[at.type], "fetchsize": str(self.batch_size)}
        if low is not None and high is not None:
            out |= {"partitionColumn": self.mapping.id, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(min(parts, at.pool_size))}
        return out

    def read(self, spark: SparkSession, pending_only: bool = True, **options) -> DataFrame:
        """The table over JDBC (``options`` as above); with bounds of its id it is read in parts at the same time, no more than the pool has connections."""
        return spark.read.format("jdbc").options(**self.options(self.pending if pending_only else None, **options)).load()


def project(rows: DataFrame, source: Source) -> DataFrame:
    """Source rows as files: id, bucket, key, size, shard and metadata, by the column mapping."""
    from pyspark.sql import functions as F

    from ..functions import scalars as S

    m = source.mapping
    pairs = [x for k, v in m.metadata.items() for x in (F.lit(k), F.col(v).cast("string"))]
    if m.created_at and m.created_at in rows.columns:
        pairs += [F.lit("created_at"), S.iso_time(F.col(m.created_at))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    key = F.col(source.shard_key) if source.shard_key else None
    return rows.select(F.col(m.id).alias("id"), F.col(m.s3_bucket).alias("s3_bucket"), F.col(m.s3_key).alias("s3_key"), F.col(m.size_bytes).cast("long").alias("size_bytes"), S.source_shard(key, F.col(m.s3_key), source.shard_bits).cast("int").alias("shard_id"), meta.alias("metadata"))


@dataclass(frozen=True)
class Sources:
    sources: tuple[Source, ...]

    @classmethod
    def from_dict(cls, raw: dict) -> Sources:
        out = []
        for s in raw.get("sources", ()):
            s = dict(s)
            s["connection"] = Connection(**s["connection"])
            s["mapping"] = Mapping(**s["mapping"])
            out.append(Source(**s))
        return cls(tuple(out))

    @classmethod
    def from_file(cls, path: str) -> Sources:
        """JSON always, YAML where a parser is installed."""
        import json

        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs a YAML parser; use JSON") from e
        return cls.from_dict(yaml.safe_load(text))

    def enabled(self) -> list[Source]:
        return [s for s in self.sources if s.enabled]

    def read_all(self, read: Callable[[Source], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
        """The enabled sources' files in one frame, with source_rank and source_name, and the errors of those that could not be read; one failing source does not stop the others."""
        from pyspark.sql import functions as F

        out, errors = None, {}
        for rank, source in enumerate(self.enabled()):
            try:
                rows = project(read(source), source)
                rows.limit(1).collect()  # a source that cannot be reached fails here
            except Exception as e:  # noqa: BLE001  whatever it is, it is this source's alone
                errors[source.name] = str(e)
                continue
            one = rows.select(F.lit(rank).alias("source_rank"), F.lit(source.name).alias("source_name"), "*")
            out = one if out is None else out.unionByName(one)
        return out, errors

    def by_name(self, name: str) -> Source | None:
        return next((s for s in self.sources if s.name == name), None)


def from_environment(env: dict[str, str] | None = None) -> dict[str, object]:
    """Database and store settings from DATABASE_URL, STORE_URL and NODE_ID."""
    env = dict(os.environ) if env is None else env
    out: dict[str, object] = {"node_id": int(env.get("NODE_ID", "0"))}
    for name in ("DATABASE_URL", "STORE_URL"):
        if url := env.get(name):
            u = urlparse(url)
            out[name.lower()] = {"scheme": u.scheme, "host": u.hostname, "port": u.port, "path": u.path.lstrip("/"), "user": u.username}
    return out
