"""Word sets learnt from a corpus, shipped to every worker without passing through the driver.

Spark writes the words to the shared folder and hands the files to each executor, also to those that start later; a worker
reads them once. No number of words is cut off; a set must fit into a worker's memory (some tens of bytes a word).
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark import SparkFiles
from pyspark.sql import DataFrame

from warraq.runtime import shared_dir

#: Files a set is shipped in, at most.
FILES = 8


def words(df: DataFrame) -> tuple[str, ...]:
    """Ship the distinct values of the one string column of `df`; the names of the files in which `shipped` finds them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    df.distinct().coalesce(FILES).write.text(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.getPath().getName().startswith("part-")]
    for f in files:
        spark.sparkContext.addFile(f.toString())
    return tuple(f.getName() for f in files)


@cache
def shipped(names: tuple[str, ...]) -> frozenset[str]:
    """The words of such files; on a worker."""
    out: set[str] = set()
    for n in names:
        with open(SparkFiles.get(n), encoding="utf-8") as lines:
            out.update(x.rstrip("\n") for x in lines)
    return frozenset(out)
