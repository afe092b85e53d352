"""The package itself for the Python workers, which may run where it is not installed."""

import tempfile
import zipfile
from pathlib import Path

import policylens

_shipped = set()


def ship_package(spark):
    """Hand the package's sources to Spark once per application; Spark takes them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(policylens.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"policylens-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
