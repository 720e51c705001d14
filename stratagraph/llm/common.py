"""What the corpus operators share: shared-folder tables, let bindings, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a local master a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="stratagraph-")
    return f"file://{_own}"


_own: str | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratagraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)
        _written.remove((t.sparkSession, t.written_to))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, written() tables are scratch: at the end all are deleted but those handed to the function that this gives."""
    kept: list[str] = []
    before = {path for _, path in _written}

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.written_to)
        return table

    yield keep
    for entry in [e for e in _written if e[1] not in before and e[1] not in kept]:
        _delete(*entry)
        _written.remove(entry)


@atexit.register
def drop_written() -> None:
    """Delete the tables that written() made in this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone already; a cluster's own clean-up takes the folder
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows at most `rows` rows; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of text."""
    spaced = F.translate(text, "\t\n\u000b\f\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def bare(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs as one struct column `rec`, besides the named columns under safe names `_name`: no clash with extra columns."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rec"), *[docs[c].alias(f"_{c}") for c in names])


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The inverse of bare(): documents' columns, then the added ones; an added column replaces one of the same name."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col("rec").getField(c).alias(c) for c in columns if c.lower() not in taken], *added)
