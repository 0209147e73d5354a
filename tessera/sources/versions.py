"""Versioned publication: data first, a manifest last, so that readers see whole versions only.

A publication is a folder. Each write goes to a fresh folder ``data-<uuid>`` in it; then the manifest ``v-<number>.json``
is created by a rename, which fails if another writer was there first. A manifest names the folders of all its parts, so
a version may keep parts of the one before. A writer that fails leaves data that no manifest names: ``expire`` clears it.
What a query reads while a new version comes stays until ``expire``, which keeps the last few.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Version:
    """One version: its number, the folder that it wrote, the folder of each of its parts, and what readers need to know."""

    number: int
    folder: str
    parts: dict[str, str] = field(default_factory=dict)
    about: dict[str, str] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has published this number."""


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _child(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path, name)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, in order."""
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v-(\d+)\.json", n)))


def version(spark: SparkSession, path: str, number: int) -> Version:
    fs, _ = _files(spark, path)
    stream = fs.open(_child(spark, path, f"v-{number:08d}.json"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Version(**json.loads(text))


def current(spark: SparkSession, path: str) -> Version:
    found = numbers(spark, path)
    if not found:
        raise FileNotFoundError(f"no version in {path}")
    return version(spark, path, found[-1])


@contextlib.contextmanager
def publishing(spark: SparkSession, path: str) -> Iterator[Version]:
    """A new version to write into ``folder``; it is published where the block ends without an error."""
    found = numbers(spark, path)
    new = Version((found[-1] if found else 0) + 1, f"{path.rstrip('/')}/data-{uuid.uuid4().hex}")
    yield new
    fs, _ = _files(spark, path)
    draft, final = _child(spark, path, f".draft-{uuid.uuid4().hex}"), _child(spark, path, f"v-{new.number:08d}.json")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(new.__dict__).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {path} was published meanwhile")


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> Version:
    """Publish what ``write`` writes into the folder that it is given, as a version of one part."""
    with publishing(spark, path) as new:
        write(new.folder)
        new.parts = {"all": new.folder}
    return new


def read(spark: SparkSession, path: str, reader: Callable[[str], DataFrame] | None = None, number: int | None = None) -> DataFrame:
    """The current version (or one by its number), as Parquet or by another reader of its folder."""
    found = current(spark, path) if number is None else version(spark, path, number)
    return (reader or spark.read.parquet)(found.parts["all"])


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all versions but the last ``keep``, and data that none of those names. Not while a writer is at work."""
    fs, folder = _files(spark, path)
    found = numbers(spark, path)
    stay = {p.rstrip("/").rpartition("/")[2] for n in found[-keep:] for p in version(spark, path, n).parts.values()}
    for n in found[:-keep]:
        fs.delete(_child(spark, path, f"v-{n:08d}.json"), False)
    gone = [s.getPath().getName() for s in fs.listStatus(folder)]
    gone = [n for n in gone if n.startswith((".draft-", "data-")) and n not in stay]
    for n in gone:
        fs.delete(_child(spark, path, n), True)
    return sorted(gone)
