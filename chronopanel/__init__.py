"""chronopanel: entity-by-date panel analytics as PySpark DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Make the package importable in Python workers; once per application.

    Not needed when it is installed on the executors or passed with --py-files.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="chronopanel-"), "chronopanel.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
