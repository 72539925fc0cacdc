"""The package's own way to the Python workers.

Workers unpickle functions by the name of their module, so they must be able to
import this package.  Where it is installed they can.  Elsewhere ``ship`` sends it
along once a Spark context: as an archive of its sources, through Spark's own file
distribution, so that executors on other machines get it too.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the workers of the session's context; once is enough, more do nothing."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quire-")) / "quire_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(spark.sparkContext.applicationId)


def arrow_udf(function: Callable, returns: str) -> Callable:
    """``F.arrow_udf`` of a function of this package."""
    ship()
    return F.arrow_udf(function, returns)
