"""Sends this package to Python workers that can't import it otherwise."""

from __future__ import annotations

import io
import os
import zipfile
from hashlib import sha256
from pathlib import Path

from pyspark.sql import SparkSession

from quillmine.sources.tables import shared_folder

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def _archive() -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(path.relative_to(_ROOT.parent))), path.read_bytes())
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Put the package into the shared folder and on the workers' path, once an application, unless PYTHONPATH already leads to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    data = _archive()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{shared_folder(spark)}/quillmine/quillmine-{sha256(data).hexdigest()[:16]}.zip")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        out = files.create(target, False)
        out.write(bytearray(data))
        out.close()
    context.addPyFile(files.makeQualified(target).toString())
    _shipped.add(context.applicationId)
