"""Intermediate tables of the corpus operators.

Every intermediate result lives under the shared folder that the session names
in ``spark.checkpoint.dir``; a lost executor costs a re-read of a written table.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

from costwise.session import checkpoint_dir


def scratch(spark, name: str) -> str:
    """A new path for one table below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefixed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: what an operator reads of a wider table."""
    return df.select(*[df[c] for c in columns])


def salt_count(df: DataFrame) -> int:
    """Salts for splitting a hot key: as many as the session's shuffle partitions."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark) -> None:
    """Let the executors import this package: once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="costwise-py-")) / "costwise_package.zip"  # the driver serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, function, schema, barrier: bool = False) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema, barrier)


def bounded(batches, size: int = 2 << 20):
    """The batches in runs of rows of about ``size`` bytes, so that what a worker makes of a batch does not follow the session's batch size."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
