"""The versioned bar store: bars are only ever added, and count once a commit names them.

A write puts files under data/write=<id>/symbol=/year=, then makes its commit, a small file whose name is the commit's number, by
a rename that fails if the number is taken. Readers take the commits there are when they begin: a job that dies before its
commit leaves files that no reader looks at. A batch's name is in its commit, so that the same batch changes nothing the second time.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("symbol", "dt")


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The store's commits by number: dicts of number, batch, write, schema and, of a compaction, through: the last commit that it holds."""
    fs, p = _folder(spark, f"{path}/commits")
    if not fs.exists(p):
        return []
    out = []
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(f.getPath())
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()) | {"number": int(name[:-5])})
            finally:
                stream.close()
    return sorted(out, key=lambda c: c["number"])


def is_store(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, f"{path}/commits")
    return fs.exists(p)


def _commit(spark: SparkSession, path: str, entry: dict) -> int:
    """Makes the next commit and returns its number, or that of the batch if another writer has committed it meanwhile."""
    fs, _ = _folder(spark, path)
    text = json.dumps(entry).encode()
    while True:
        known = commits(spark, path)
        for c in known:
            if c["batch"] == entry["batch"]:
                return c["number"]
        number = known[-1]["number"] + 1 if known else 1
        _, made = _folder(spark, f"{path}/commits/.{uuid.uuid4().hex}.tmp")
        _, final = _folder(spark, f"{path}/commits/{number:012d}.json")
        stream = fs.create(made, True)
        stream.write(text)
        stream.close()
        jvm = spark._jvm
        no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a rename that doesn't replace: of two writers only one gets the number
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, final, no_options)
        except Py4JJavaError as e:
            fs.delete(made, False)
            if not fs.exists(final):
                raise e
            continue
        return number


def _write(bars: DataFrame, path: str) -> tuple[str, str]:
    write = uuid.uuid4().hex
    d = bars.withColumn("year", F.year("dt")).repartition("symbol", "year").sortWithinPartitions("symbol", "year", "dt")
    d.write.partitionBy("symbol", "year").parquet(f"{path}/data/write={write}")
    return write, bars.schema.json()


def add_bars(bars: DataFrame, path: str, batch: str | None = None, order: list[Column] | None = None) -> int:
    """Commits bars (symbol, dt, ...) and returns the commit's number. Stored bars win over new ones of the same symbol and time.

    Of several new ones the first by `order` (all other columns, if it isn't given) is kept. A batch of a name that is
    committed already changes nothing. An empty table is a commit, too.
    """
    spark = bars.sparkSession
    if batch is not None:
        for c in commits(spark, path):
            if c["batch"] == batch:
                return c["number"]
    w = Window.partitionBy(*KEYS).orderBy(*(order or [F.col(c) for c in bars.columns if c not in KEYS] or [F.lit(0)]))
    d = bars.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    write, schema = _write(d, path)
    return _commit(spark, path, {"batch": batch or f"write-{write}", "write": write, "schema": schema})


def _live(known: list[dict]) -> list[dict]:
    """The commits that a reader of all of `known` takes, first come first: the last compaction, and what it doesn't hold."""
    base = [c for c in known if "through" in c][-1:]
    through = base[0]["through"] if base else 0
    return base + [c for c in known if "through" not in c and c["number"] > through]


def snapshot(spark: SparkSession, path: str, version: int | None = None, symbol: str | None = None) -> DataFrame:
    """The bars as of a commit (the last, if none is given): one a symbol and time, that of the earliest commit. Later commits don't change it.

    A symbol's bars are read from its folders alone. Columns are those of the version's last commit; NULL where an earlier one lacks them.
    """
    known = [c for c in commits(spark, path) if version is None or c["number"] <= version]
    if not known or (version is not None and known[-1]["number"] != version):
        raise ValueError(f"no commit {'' if version is None else version} in {path}")
    live = _live(known)
    schema = T.StructType.fromJson(json.loads(live[-1]["schema"]))
    stored = T.StructType([*schema.fields, T.StructField("year", T.IntegerType()), T.StructField("write", T.StringType())])
    d = spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*(f"{path}/data/write={c['write']}" for c in live))
    if symbol is not None:
        d = d.where(F.col("symbol") == symbol)
    if len(live) == 1:
        return d.select(*schema.names)
    place = F.create_map(*(x for i, c in enumerate(live) for x in (F.lit(c["write"]), F.lit(i))))[F.col("write")]
    rest = [n for n in schema.names if n not in KEYS]
    first = d.groupBy(*KEYS).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_")), place).alias("_first"))
    return first.select(*(n if n in KEYS else F.col(f"_first.{n}").alias(n) for n in schema.names))


def compact(spark: SparkSession, path: str) -> int:
    """Writes the present snapshot as one commit, so that readers need no merge. Batches committed meanwhile stay beside it."""
    through = commits(spark, path)[-1]["number"]
    write, schema = _write(snapshot(spark, path, through), path)
    return _commit(spark, path, {"batch": f"compaction-{write}", "write": write, "schema": schema, "through": through})


def vacuum(spark: SparkSession, path: str, older_than_hours: float = 168.0) -> list[str]:
    """Deletes the files of writes that the present snapshot doesn't read and that are older than any job that may still write or read them; returns their ids."""
    fs, p = _folder(spark, f"{path}/data")
    needed = {c["write"] for c in _live(commits(spark, path))}
    limit = spark._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3600_000
    gone = []
    for f in fs.listStatus(p) if fs.exists(p) else []:
        write = f.getPath().getName().removeprefix("write=")
        if write not in needed and f.getModificationTime() < limit:
            fs.delete(f.getPath(), True)
            gone.append(write)
    return sorted(gone)
