"""What the text operators share: table access, held-out splits, checkpoints and batched mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def held_out(key: Column, n: int, rest: int) -> Column:
    """True for the rows that no label is learned from. A NULL key is not held out, and not learned from either."""
    return F.coalesce(crc_remainder(key, n) == rest, F.lit(False))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once a row.

    Filters and later columns would otherwise have the expression copied into them, into each step of a lambda too;
    the optimizer moves nothing across a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_checkpoints(spark: SparkSession) -> None:
    """Keeps the session's checkpoint folder. Without one a session on one machine (tests) gets a temporary folder; on a cluster, whose executors share none, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def drop_intermediate(spark: SparkSession) -> None:
    """Deletes what written(), checkpointed() and shared_file() have left in the shared folder; for when no DataFrame made from them is read any more."""
    sc = spark.sparkContext
    if (folder := sc.getCheckpointDir()) is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        for file in fs.listStatus(path):
            fs.delete(file.getPath(), True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that it is computed once and outlives executors."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared checkpoint folder and reads it again."""
    with_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared checkpoint folder; returns its path."""
    with_checkpoints(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return path.toString()


def most_frequent(counts: DataFrame, most: int, value: str = "w", count: str = "c") -> list[tuple]:
    """The values of the highest counts, at most `most`, and their counts; values about as frequent as each other are in or out together.

    A histogram of the counts' logarithms gives the least count, so that only the chosen values reach the driver.
    """
    band = F.floor(F.log(count) * 20)
    total, least = 0, None
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():  # under a thousand
        total += r["count"]
        if total > most:
            break
        least = r["band"]
    if least is None:
        return []
    return sorted(((r[value], r[count]) for r in counts.where(band >= least).select(value, count).collect()), key=lambda x: (-x[1], x[0]))


def slices(batch: pa.RecordBatch, text_at: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most most_bytes of text, or of one row."""
    lengths = pc.binary_length(batch.column(text_at)).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        n = n or 0
        if i > begin and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(lengths) > begin:
        yield batch.slice(begin)


def map_texts(df: DataFrame, columns: list[Column], text_at: int, factory: Callable[[], Callable], schema: list[tuple[str, str]], most_bytes: int = 4 << 20) -> DataFrame:
    """Applies a Python function to lists of whole column values, a few MB of text at a time.

    factory runs once a task and returns the function, which takes one list a column and returns one list for each
    column of the schema. Memory is bounded by most_bytes and by the longest text.
    """
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for part in slices(batch, text_at, most_bytes):
                out = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.select(*columns).mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in schema))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, label) to learn from: of each class the per_class rows with the least hash of the id.

    Repeated rows of labels count once, and ids with both labels teach nothing. At most 2 * per_class ids are kept, so that their broadcast has a proven bound whatever
    the size of labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).where(learn).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most"))
    known = known.where(F.col("label") == F.col("_most")).select("_id", "label", F.xxhash64("_id").alias("_h"))
    part = [known.where(F.col("label") == v).orderBy("_h", "_id").limit(per_class) for v in (0, 1)]
    chosen = part[0].unionByName(part[1])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "label", "_h")


def label_shares(labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id") -> dict[int, int]:
    """How many ids have label 0 and 1, as labelled_sample counts them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).where(learn).groupBy(id_col).agg(F.min(label).cast("int").alias("v"), F.max(label).cast("int").alias("w"))
    return {r["v"]: r["count"] for r in known.where("v = w").groupBy("v").count().collect()}
