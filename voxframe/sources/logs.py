"""Text and JSON files of a run: results, parameters, hyper-parameters, detections as one object."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.volume import _read, _write


def block_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in parts])


def stamped(message: Column, ts: Column) -> Column:
    """[date time] message"""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), message)


def append_text(lines: DataFrame, path: str) -> None:
    """Add the lines (ts, message) to a folder of text files, each with its time."""
    lines.select(stamped(F.col("message"), F.col("ts")).alias("value")).write.mode("append").text(path)


def dump_parameters(config: dict, path: str) -> None:
    _write(path, json.dumps(config, indent=2).encode())


def read_parameters(path: str) -> dict:
    raw = _read(path)
    if raw is None:
        raise FileNotFoundError(path)
    return json.loads(raw)


def hyper_parameters(spark: SparkSession, config: dict) -> DataFrame:
    """(name, value, number) of the scalar entries of a nested configuration, named by path; truth values are numbers."""
    out = []

    def walk(prefix: str, node: dict) -> None:
        for k, v in node.items():
            name = f"{prefix}/{k}" if prefix else k
            if isinstance(v, dict):
                walk(name, v)
            elif isinstance(v, bool | int | float):
                out.append((name, str(v), float(v)))
            elif isinstance(v, str):
                out.append((name, v, None))

    walk("", config)
    return spark.createDataFrame(out, "name string, value string, number double")


def encoded(det: DataFrame, columns: list[str]) -> DataFrame:
    """(json) one object a row."""
    return det.select(F.to_json(F.struct(*columns)).alias("json"))


def decoded(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("json", schema).alias("r")).select("r.*")


def write_object(det: DataFrame, path: str, columns: list[str]) -> int:
    """One JSON object {"synapses": [...], "n": ...} in one file, row by row from the driver's iterator, which holds one
    partition at a time. Returns n."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    n = 0
    with store.open_output_stream(name) as f:
        f.write(b'{"synapses": [')
        for r in encoded(det, columns).toLocalIterator():
            f.write((",\n" if n else "\n").encode() + r["json"].encode())
            n += 1
        f.write(f'\n], "n": {n}}}\n'.encode())
    return n
