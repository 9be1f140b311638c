"""A registry of companies kept in files, as a data source: spark.read.format("registry").load(path).

A store is a folder with files of answers, one JSON object a line, and an index that names each file with the first and
the last number in it. A reader looks at the index and takes a partition for each file whose range a query's filters on
number leave; a writer's tasks put files beside the old ones, and its commit puts a new index in place by one rename.
A write that is aborted, or dies, is in no index. The folder must be one that the driver and all executors see as a
local path, as a mounted share is.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tallyloom.functions import codes

SCHEMA = "number string, name string, legal_form string, status string, active boolean, address string, postal_code string, city string, industry string, raw string"
#: Fields of an answer that become columns as they are.
PLAIN = ("name", "legal_form", "status", "active", "address", "postal_code", "city")
INDEX, BATCH = "index.json", 10_000
#: Hits that a search gives at most, and characters that a search needs.
HITS, LEAST = 10, 3


def local(path: str) -> str:
    """The path as Python opens it; an error for paths in a store that only Spark reads."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"the registry needs a path that is mounted on every machine, not {path}")
    return bare.rstrip("/")


def index(path: str) -> list[dict]:
    """Files of a store with first and last number and rows; none before the first commit."""
    try:
        with open(f"{path}/{INDEX}") as f:
            return json.load(f)
    except FileNotFoundError:
        return []


@dataclass
class Bounds:
    """What filters say of number: its range, both ends included, and the values that it may have."""

    low: str = ""
    high: str | None = None
    among: frozenset[str] | None = None
    tests: list[Filter] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Narrows the range by a filter on number; False if it is about something else."""
        if getattr(f, "attribute", None) != ("number",):
            return False
        if isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str) or isinstance(f, In):
            values = frozenset(v for v in (f.value if isinstance(f, In) else (f.value,)) if isinstance(v, str))
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, str):
            self.low = max(self.low, f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, str):
            self.high = f.value if self.high is None else min(self.high, f.value)
        else:
            return False
        self.tests.append(f)
        return True

    def touches(self, first: str, last: str) -> bool:
        return last >= self.low and (self.high is None or first <= self.high) and (self.among is None or any(first <= x <= last for x in self.among))

    def holds(self, number: str) -> bool:
        for f in self.tests:
            v = f.value
            ok = (
                number in v if isinstance(f, In) else number == v if isinstance(f, (EqualTo, EqualNullSafe)) else number > v if isinstance(f, GreaterThan)
                else number >= v if isinstance(f, GreaterThanOrEqual) else number < v if isinstance(f, LessThan) else number <= v
            )
            if not ok:
                return False
        return True


@dataclass
class Part(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.bounds = path, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f  # Spark itself sees to these

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(x["file"]) for x in index(self.path) if self.bounds.touches(x["first"], x["last"])]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.bool_() if n == "active" else pa.string() for n in names]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        with open(f"{self.path}/{partition.file}", encoding="utf-8") as f:
            for line in f:
                row = flat(line)
                if row and self.bounds.holds(row[0]):
                    rows.append(row)
                if len(rows) >= BATCH:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


def flat(line: str) -> tuple | None:
    """An answer as a row of SCHEMA, the answer itself kept; None for one without a number, or that is no JSON object."""
    try:
        d = json.loads(line)
    except ValueError:
        return None
    if not isinstance(d, dict) or not isinstance(d.get("org_number"), str):
        return None
    text = lambda x: x if isinstance(x, (str, bool)) or x is None else json.dumps(x)
    trades = d.get("sni_codes")
    first = trades[0] if isinstance(trades, list) and trades and isinstance(trades[0], dict) else {}
    row = [text(d.get(c)) for c in PLAIN]
    row[PLAIN.index("active")] = d.get("active") if isinstance(d.get("active"), bool) else None
    row = [x if i == PLAIN.index("active") or not isinstance(x, bool) else str(x).lower() for i, x in enumerate(row)]
    return (d["org_number"], *row, text(first.get("description")), line.rstrip("\r\n"))


@dataclass
class Wrote(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceWriter):
    """Writes the column raw of each row that flat() understands; rows that come sorted by number give files with narrow
    ranges."""

    def __init__(self, path: str, overwrite: bool, columns: list[str]) -> None:
        self.path, self.overwrite, self.raw = path, overwrite, columns.index("raw")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.jsonl"
        first, last, n = None, None, 0
        try:
            with open(f"{self.path}/{name}", "w", encoding="utf-8") as f:
                for row in iterator:
                    got = flat(row[self.raw] or "")
                    if got:
                        f.write(json.dumps(json.loads(row[self.raw]), ensure_ascii=False) + "\n")
                        first, last, n = min(first or got[0], got[0]), max(last or got[0], got[0]), n + 1
        except BaseException:
            os.remove(f"{self.path}/{name}")
            raise
        if not n:
            os.remove(f"{self.path}/{name}")
            return Wrote([])
        return Wrote([{"file": name, "first": first, "last": last, "rows": n}])

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = index(self.path)
        new = sorted([x for m in messages if m for x in m.files], key=lambda x: (x["first"], x["file"]))
        part = f"{self.path}/.{INDEX}-{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(new if self.overwrite else old + new, f)
        os.replace(part, f"{self.path}/{INDEX}")
        for x in old if self.overwrite else ():
            os.remove(f"{self.path}/{x['file']}")

    def abort(self, messages: list) -> None:
        for m in messages:
            for x in m.files if m else ():
                if os.path.exists(f"{self.path}/{x['file']}"):
                    os.remove(f"{self.path}/{x['file']}")


class Registry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(local(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(local(self.options["path"]), overwrite, schema.names)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Registry)
    return spark


def store(answers: DataFrame, path: str, number: str = "number", files: int | None = None, mode: str = "append") -> None:
    """Writes answers (number, raw) in ranges of number, so that a lookup reads one file. A number that comes twice is
    kept twice; without files Spark's shuffle settings say how many there are."""
    ranged = answers.repartitionByRange(files, number) if files else answers.repartitionByRange(number)
    register(answers.sparkSession)
    ranged.sortWithinPartitions(number).select("raw").write.format("registry").mode(mode).save(path)


def valid(registry: DataFrame) -> DataFrame:
    """Companies whose number holds, with id, the ten digits that they go by."""
    check = codes.check_org_number(F.col("number"))
    return registry.withColumn("_check", check).where("_check.valid").withColumn("id", F.col("_check.digits")).drop("_check")


def lookup(registry: DataFrame, number: str) -> DataFrame:
    """The company of one number, in any way of writing it; no row if there is none or the number does not hold. Stores
    keep numbers as NNNNNN-NNNN, so one file is read."""
    ten = "".join(c for c in number if c.isdigit())
    ten = ten[2:] if len(ten) == 12 and ten.startswith("16") else ten
    return valid(registry.where(F.col("number") == f"{ten[:6]}-{ten[6:]}"))


def search(registry: DataFrame, query: str, most: int = HITS, order: Column | None = None) -> DataFrame:
    """The first companies whose name contains query, in the registry's order, which is that of numbers if none is
    given; of these the ones whose number holds. Searches of fewer than LEAST characters find nothing, and hits without
    a name or with a number that does not hold are dropped after the cut, as the registry cuts without a look at them.
    """
    wanted = query.strip().lower()
    if len(wanted) < LEAST:
        return valid(registry).limit(0)
    hits = registry.where(F.contains(F.lower("name"), F.lit(wanted))).orderBy(F.col("number") if order is None else order, "raw").limit(most)
    return valid(hits.where(F.col("name") != ""))


def companies(stored: DataFrame) -> DataFrame:
    """Stored companies that are not deleted."""
    return stored.where("deleted_at = 0")


def company(stored: DataFrame, number: str) -> DataFrame:
    """The stored company (id, ten digits) of a number in any way of writing it, unless it is deleted."""
    spark = stored.sparkSession
    asked = spark.range(1).select(codes.ten_digits(F.lit(number)).alias("_ten"))
    ten = asked.first()["_ten"]
    return companies(stored.where(F.col("id") == ten)) if ten else stored.limit(0)
