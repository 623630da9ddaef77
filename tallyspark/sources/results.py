"""Stored results: each version is a table of its own, and a manifest for each id says which one counts.

A version counts from the moment its manifest is in place, which is one move of a file; saving an id again
replaces it for all later readers, and of two writers the one that comes last stays. Listing reads manifests only.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbooks import file_name, opened

MANIFEST = "result_id string, version string, created timestamp"


def save_result(result: DataFrame, path: str, result_id: str) -> str:
    """Writes a result and lets its id name it."""
    version = uuid.uuid4().hex
    result.write.parquet(f"{path}/data/{version}")
    where, base = opened(path)
    where.create_dir(f"{base}/manifests", recursive=True)
    made = file_name(result_id, ".json")
    with where.open_output_stream(f"{base}/manifests/_{version}") as out:
        out.write(json.dumps({"result_id": result_id, "version": version, "created": datetime.datetime.now(datetime.UTC).isoformat()}).encode())
    where.move(f"{base}/manifests/_{version}", f"{base}/manifests/{made}")
    return result_id


def _manifest(path: str, result_id: str) -> dict:
    where, base = opened(path)
    try:
        with where.open_input_stream(f"{base}/manifests/{file_name(result_id, '.json')}") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        raise KeyError(result_id) from None


def get_result(spark: SparkSession, path: str, result_id: str) -> DataFrame:
    """The result that an id names now, with its id; KeyError for an id that was never saved."""
    return spark.read.parquet(f"{path}/data/{_manifest(path, result_id)['version']}").withColumn("result_id", F.lit(result_id))


def list_results(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """(result_id, created) of the latest results, newest first."""
    where, base = opened(path)
    if where.get_file_info(f"{base}/manifests").type != fs.FileType.Directory:
        return spark.createDataFrame([], "result_id string, created timestamp")
    return spark.read.schema(MANIFEST).json(f"{path}/manifests").select("result_id", "created").orderBy(F.desc("created"), "result_id").limit(limit)


def clear_versions(spark: SparkSession, path: str) -> int:
    """Deletes versions that no manifest names, once nobody reads or writes them any more; their number."""
    where, base = opened(path)
    live = {r.version for r in spark.read.schema(MANIFEST).json(f"{path}/manifests").select("version").collect()}  # one for each id
    gone = [f.path for f in where.get_file_info(fs.FileSelector(f"{base}/data")) if f.base_name not in live]
    for old in gone:
        where.delete_dir(old)
    return len(gone)
