"""Sends this package to the executors of a session."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from evalloom.session import remove, shared_dir

_SENT: set[str] = set()


def _packed() -> bytes:
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once, so that Python workers can import it wherever they run.

    The archive lies in the shared folder; where no such folder is set, in a file of the driver, from which Spark serves it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    try:
        name = f"{shared_dir(spark)}/evalloom-{sc.applicationId}-code/evalloom.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        stream.write(_packed())
        stream.close()
        atexit.register(remove, sc._jvm, sc._jsc.hadoopConfiguration(), name.rsplit("/", 1)[0])
    except ValueError:
        handle, name = tempfile.mkstemp(prefix="evalloom-", suffix=".zip")
        os.write(handle, _packed())
        os.close(handle)
        atexit.register(lambda: os.path.exists(name) and os.unlink(name))
    sc.addPyFile(name)
    _SENT.add(sc.applicationId)
