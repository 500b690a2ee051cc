"""Source files as rows: SQL, application code and mapper files, whole or only those that changed."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by how statements are found in the file.
ROUTES = {"sql": "script", "py": "python", "ts": "typescript", "js": "typescript", "java": "java", "go": "go", "rb": "ruby", "xml": "mapper"}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """file, content, suffix, route, content_sha of every file below a path; other suffixes have a null route.

    Files are read whole, one row each, in parallel; content that is no UTF-8 is null.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.try_validate_utf8(F.col("content").cast("string"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return raw.select(F.regexp_replace("path", "^file:", "").alias("file"), content.alias("content"), suffix.alias("suffix"), routes[suffix].alias("route"), F.sha2("content", 256).alias("content_sha"))


def changed_files(folder: str, since: str = "HEAD") -> list[str]:
    """Paths changed since a commit, staged or untracked, that exist; asked of git on the driver."""
    out: set[str] = set()
    for args in (["diff", "--name-only", "--diff-filter=d", since], ["diff", "--name-only", "--diff-filter=d", "--cached"], ["ls-files", "--others", "--exclude-standard"]):
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        if done.returncode:
            raise ValueError(done.stderr.strip() or "git failed")
        out.update(x for x in done.stdout.splitlines() if x)
    return sorted(out)


def only_files(sources: DataFrame, paths: list[str]) -> DataFrame:
    """Sources whose path is, or ends in, one of the paths; the list comes from a command line or git."""
    if not paths:
        return sources.limit(0)
    wanted = F.broadcast(sources.sparkSession.createDataFrame([(p,) for p in paths], "wanted string"))
    return sources.join(wanted, (F.col("file") == F.col("wanted")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("wanted"))), "left_semi")
