"""Immutable table versions behind one pointer, manifests, locks and sentinels on any Hadoop file system."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from keyweave.model import TableDef


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


class Files:
    """Small files through Hadoop's API, so that they live wherever the tables do."""

    def __init__(self, spark: SparkSession, base: str):
        self._spark, self._jvm = spark, spark._jvm
        self.base = base.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a temporary file is renamed over the old one in one step, so readers see one of the two."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        overwrite = getattr(hadoop, "Options$Rename").OVERWRITE
        how = self._spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = overwrite
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self._spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._path(temporary)), self._fs.makeQualified(self._path(name)), how)

    def create(self, name: str) -> bool:
        """False if the file exists: the basis of locks."""
        return self._fs.createNewFile(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []


def lock_name(schema: str, table: str) -> str:
    """Advisory lock name: readable heads of both names and a hash of the whole."""
    return f"{schema[:20]}.{table[:32]}-{hashlib.sha1(f'{schema}.{table}'.encode()).hexdigest()[:8]}"


#: Seconds that a lock holds without a beat of its owner.
LEASE_S = 60.0


class Locked(RuntimeError):
    """Someone else holds the lock."""


@dataclass
class Store:
    """A table as immutable versions; CURRENT names the one that readers see.

    A version is a folder, or a manifest that lists the folders of its key ranges, so that a new version shares the
    folders that it did not touch.
    """

    spark: SparkSession
    base: str
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    _beat: threading.Event | None = field(default=None, repr=False)

    def __post_init__(self):
        self.files = Files(self.spark, self.base)

    def write(self, df: DataFrame, name: str | None = None) -> str:
        name = name or f"v{time.time_ns()}"
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return name

    def read(self, name: str | None = None) -> DataFrame:
        name = name or self.current()
        if not self.files.exists(f"{name}.json"):
            return self.spark.read.parquet(f"{self.base}/{name}")
        schema, parts = self.manifest(name)
        return self.read_parts(schema, list(parts.values()))

    def read_parts(self, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{f}" for f in folders])

    def write_parts(self, df: DataFrame, by: str, name: str) -> dict[int, str]:
        """One folder for each value of the integer column `by`: value to folder."""
        df.write.mode("overwrite").partitionBy(by).parquet(f"{self.base}/{name}")
        found = (n for n in self.files.names(name) if n.startswith(f"{by}="))
        return {int(n.split("=")[1]): f"{name}/{n}" for n in found}

    def write_manifest(self, schema: StructType, parts: dict[int, str], name: str | None = None) -> str:
        name = name or f"m{time.time_ns()}"
        self.files.write(f"{name}.json", json.dumps({"schema": json.loads(schema.json()), "parts": sorted(parts.items())}))
        return name

    def manifest(self, name: str) -> tuple[StructType, dict[int, str]]:
        got = json.loads(self.files.read(f"{name}.json"))
        return StructType.fromJson(got["schema"]), {k: f for k, f in got["parts"]}

    def current(self) -> str:
        return self.files.read("CURRENT").strip()

    def swap(self, name: str) -> str | None:
        """Point readers at another version; returns the old one, which stays until it is dropped."""
        old = self.current() if self.files.exists("CURRENT") else None
        self.files.write("CURRENT", name)
        return old

    def drop(self, name: str) -> None:
        """Remove a version with the folders that no reader of the current one needs."""
        if self.files.exists("CURRENT") and self.current() == name:
            raise ValueError("the current version cannot be dropped")
        if self.files.exists(f"{name}.json"):
            _, parts = self.manifest(name)
            now = self.current() if self.files.exists("CURRENT") else None
            kept = set(self.manifest(now)[1].values()) if now and self.files.exists(f"{now}.json") else set()
            for folder in set(parts.values()) - kept:
                self.files.delete(folder)
            self.files.delete(f"{name}.json")
        self.files.delete(name)

    def define(self, table: TableDef) -> None:
        """Keep the table's definition and, through it, changes that touch no row."""
        self.files.write("TABLE", table.to_json())

    def definition(self) -> TableDef | None:
        return TableDef.from_json(self.files.read("TABLE")) if self.files.exists("TABLE") else None

    def writable(self) -> bool:
        probe = f"probe-{uuid.uuid4().hex}"
        try:
            self.files.create(probe)
            self.files.delete(probe)
            return True
        except Exception:  # the file system's own errors differ
            return False

    # Checkpoints: numbered manifests of which the newest counts.
    FIELDS = ("copier_watermark", "checksum_watermark", "position", "rows_copied", "rows_copied_logical", "statement", "parts")

    def save_checkpoint(self, **fields) -> int:
        if set(fields) != set(self.FIELDS):
            raise ValueError("a checkpoint has other fields")
        names = [n for n in self.files.names("checkpoints") if n.endswith(".json")]
        n = int(names[-1].split(".")[0]) + 1 if names else 1
        self.files.write(f"checkpoints/{n:08d}.json", json.dumps(fields))
        for old in names[:-1]:  # the one before stays until the next is whole
            self.files.delete(f"checkpoints/{old}")
        return n

    def load_checkpoint(self) -> dict | None:
        """The newest manifest; one of another shape is an error, not a guess."""
        names = [n for n in self.files.names("checkpoints") if n.endswith(".json")]
        if not names:
            return None
        got = json.loads(self.files.read(f"checkpoints/{names[-1]}"))
        if set(got) != set(self.FIELDS):
            raise ValueError("the checkpoint was written by another version")
        return got

    def clear_checkpoints(self) -> None:
        self.files.delete("checkpoints")

    def lock(self, schema: str = "", table: str = "", lease_s: float = LEASE_S, clock=time.time) -> None:
        """Take the table's advisory lock, and keep it by a beat every third of a lease.

        The lock file tells its owner and until when it holds. One whose lease is over belongs to a driver that died;
        it is taken over, and of several that try, the one whose name is in the file then has it.
        """
        self._lock = f"LOCK-{lock_name(schema, table)}"
        if not self.files.create(self._lock):
            for _ in range(20):  # a lock that was just made has no owner in it yet
                if holder := self._holder():
                    break
                time.sleep(0.1)
            if holder and holder["owner"] != self.owner and holder["until"] > clock():
                raise Locked(f"{self.base}: {holder['owner']}")
        renew = lambda: self.files.write(self._lock, json.dumps({"owner": self.owner, "until": clock() + lease_s}))
        renew()
        if (holder := self._holder()) and holder["owner"] != self.owner:
            raise Locked(f"{self.base}: {holder['owner']}")
        self._beat = threading.Event()

        def beat(stop: threading.Event) -> None:
            while not stop.wait(lease_s / 3):
                renew()

        threading.Thread(target=beat, args=(self._beat,), daemon=True).start()

    def _holder(self) -> dict | None:
        text = self.files.read(self._lock) if self.files.exists(self._lock) else ""
        return json.loads(text) if text else None

    def held(self) -> bool:
        """Whether this store still owns its lock."""
        holder = self._holder()
        return bool(holder and holder["owner"] == self.owner)

    def unlock(self) -> None:
        if self._beat:
            self._beat.set()
        self.files.delete(self._lock)
