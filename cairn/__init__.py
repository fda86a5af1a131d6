"""Spark-native spatial lookup and data-preparation engine."""

from __future__ import annotations


def ship(spark) -> str:
    """Gives this package to the session's executors, for clusters on which it is not installed. The archive's path."""
    import pathlib
    import shutil
    import tempfile

    root = pathlib.Path(__file__).parent
    path = shutil.make_archive(f"{tempfile.mkdtemp(prefix='cairn-')}/cairn", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(path)
    return path
