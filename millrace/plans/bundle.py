"""A saved pipeline that travels: one folder with the JSON file and every learned table, all paths relative.

    <folder>/tables/<n>      learned tables, Parquet
    <folder>/manifest        one text file: the pipeline file, and rows and checksum of each table

Tables are written first. The manifest comes last through Spark's own committer, whose final step is the rename of one part
file, so a folder either has a whole manifest whose tables are all there, or none, and counts as not published. A bundle
is never changed: a new fit is a new folder. Loading checks the JSON's digest and, unless told otherwise, the rows and
contents of each table, so a table that was lost, cut short or changed is an error and not a column of nulls.
"""
from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import spec as S

FORMAT, VERSION = "millrace-bundle", 1


class BundleError(S.SpecError):
    """The folder is no whole bundle."""


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _contents(table: DataFrame) -> dict:
    """Rows and a checksum that does not depend on their order."""
    digest = F.xxhash64(*table.columns).cast("decimal(38,0)")
    r = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum")).first()
    return {"rows": r["rows"], "checksum": r["checksum"]}


def _tables(state, found: list[dict]) -> list[dict]:
    """The places of a pipeline's state that name a learned table."""
    if isinstance(state, dict):
        if isinstance(state.get("table"), str):
            found.append(state)
        for v in state.values():
            _tables(v, found)
    elif isinstance(state, list):
        for v in state:
            _tables(v, found)
    return found


def save_bundle(spark: SparkSession, spec: dict, folder: str) -> dict:
    """Copies the learned tables into the folder and publishes the manifest; returns it. The folder must be new."""
    folder = folder.rstrip("/")
    body = json.loads(S.dumps(spec))
    tables = []
    for i, place in enumerate(_tables(body["pipeline_state"], [])):
        name = f"tables/{i}"
        spark.read.parquet(place["table"]).write.parquet(f"{folder}/{name}")
        tables.append({"name": name} | _contents(spark.read.parquet(f"{folder}/{name}")))
        place["table"] = name
    text = json.dumps(body, sort_keys=True)
    manifest = {"format": FORMAT, "version": VERSION, "tables": tables, "digest": _digest(text), "spec": text}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def load_bundle(spark: SparkSession, folder: str, check_tables: bool = True) -> dict:
    """The pipeline file of a bundle, its learned tables found inside the folder, wherever that is now."""
    folder = folder.rstrip("/")
    try:
        lines = [r["value"] for r in spark.read.text(f"{folder}/manifest").collect()]
    except AnalysisException as e:
        raise BundleError(f"{folder} has no published manifest") from e
    try:
        manifest = json.loads(lines[0]) if len(lines) == 1 else {}
    except ValueError:
        manifest = {}
    if manifest.get("format") != FORMAT or manifest.get("version") != VERSION or _digest(manifest["spec"]) != manifest["digest"]:
        raise BundleError(f"the manifest of {folder} is damaged or of another format")
    spec = S.loads(manifest["spec"])
    for t in manifest["tables"] if check_tables else ():
        try:
            have = _contents(spark.read.parquet(f"{folder}/{t['name']}"))
        except (AnalysisException, Py4JJavaError) as e:
            raise BundleError(f"{t['name']} of {folder} cannot be read") from e
        if have != {"rows": t["rows"], "checksum": t["checksum"]}:
            raise BundleError(f"{t['name']} of {folder} is not the table that was saved")
    known = {t["name"] for t in manifest["tables"]}
    for place in _tables(spec["pipeline_state"], []):
        if place["table"] not in known:
            raise BundleError(f"{place['table']} is not part of {folder}")
        place["table"] = f"{folder}/{place['table']}"
    return spec
