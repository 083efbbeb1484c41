"""wirefold: Protocol Buffers messages as Spark columns."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark) -> None:
    """Make this package importable in Spark's Python workers.

    Nothing happens where the workers find it already (it is installed, on
    PYTHONPATH or in the working directory).  Else a zip of the package is
    added to the session, once; Spark itself hands it to the executors.
    """
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    if _ROOT in known or app in _shipped or "site-packages" in _ROOT.parts:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="wirefold-zip-")
    # the driver serves this file to executors as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/wirefold", "zip", _ROOT, "wirefold"))
