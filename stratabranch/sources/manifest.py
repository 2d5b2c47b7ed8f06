"""Provenance of reference results: what files hold, and the digests that they must have.

A manifest is text: `key = value` lines, then a block `[file NAME]` of such lines for each file. A value
that takes several lines is left empty on its own, and comments behind it are its lines. Other comments and
empty lines don't count. A file that isn't registered, or isn't what was registered, is refused.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# The format that is read, the usual name and place of a manifest, what a record must have,
# and what stands for no shape or pattern.
FORMAT = "reference-manifest/1"
NAME, USUAL = "manifest.txt", "validation/reference/manifest.txt"
REQUIRED = ("sha256", "orientation")
NONE = ("", "-", "none")
#: Names a manifest, if set.
VARIABLE = "STRATABRANCH_MANIFEST"

_LINE = re.compile(r"#\s*(?P<note>.*)|\[file\s+(?P<file>.+?)\s*\]|(?P<key>[^=]+?)\s*=\s*(?P<value>.*)")


class ProvenanceError(ValueError):
    """A file that isn't registered, or isn't what was registered."""


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file that Spark can read."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if found is None:
        raise ProvenanceError(f"there is no file at {path}")
    return found[0]


def render(header: dict[str, str], files: dict[str, dict[str, str]]) -> str:
    def lines(key: str, value: str) -> Iterator[str]:
        first, *more = str(value).splitlines() or [""]
        yield f"{key} =" if more else f"{key} = {first}"
        yield from (f"# {x}" for x in (first, *more) if more)

    out = [x for key, value in {"format": FORMAT, **header}.items() for x in lines(key, value)]
    for name in sorted(files):
        out += ["", f"[file {name}]", *(x for key, value in files[name].items() for x in lines(key, value))]
    return "\n".join(out) + "\n"


def parse(text: str) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The header, and a record for each file."""
    header: dict[str, str] = {}
    files: dict[str, dict[str, str]] = {}
    into, open_key = header, None
    for n, line in enumerate(text.splitlines(), 1):
        if not (line := line.strip()):
            continue
        m = _LINE.fullmatch(line)
        if m is None:
            raise ProvenanceError(f"line {n} is neither a block, a value nor a comment")
        if m["note"] is not None:
            if open_key:
                into[open_key] = f"{into[open_key]} {m['note']}".strip()
            continue
        if m["file"]:
            if m["file"] in files:
                raise ProvenanceError(f"line {n}: {m['file']} is registered twice")
            into, open_key = files.setdefault(m["file"], {}), None
        else:
            into[m["key"]] = m["value"]
            open_key = None if m["value"] else m["key"]
    if not header.get("format", "").endswith(FORMAT):
        raise ProvenanceError(f"the manifest's format is {header.get('format')!r}, and not {FORMAT}")
    return header, files


def places(reference: str, given: str | None = None) -> list[Path]:
    """Where the manifest of a file may lie: where it is said to, else where the variable says, beside the
    file, or in the usual place below a folder above it."""
    if given:
        return [Path(given) / NAME, Path(given)] if Path(given).is_dir() else [Path(given)]
    here = Path(reference).absolute()
    named = [Path(os.environ[VARIABLE])] if os.environ.get(VARIABLE) else []
    return [*named, here.parent / NAME, *(up / USUAL for up in here.parents)]


def load(reference: str, given: str | None = None) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    for place in places(reference, given):
        if place.is_file():
            return parse(place.read_text())
    raise ProvenanceError(f"no manifest registers {reference}")


def shape(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Rows and columns of a CSV file, without the first, which names its rows."""
    rows = spark.read.option("header", True).csv(path)
    return rows.count(), rows.columns[1:]


def record(spark: SparkSession, path: str, orientation: str = "site-by-index", columns_pattern: str = "-", **more: str) -> dict[str, str]:
    """What is registered of a CSV file."""
    rows, columns = shape(spark, path)
    return {"sha256": digest(spark, path), "orientation": orientation, "columns_pattern": columns_pattern, "rows": str(rows), "cols": str(len(columns)), **more}


def verify(spark: SparkSession, path: str, name: str, files: dict[str, dict[str, str]], needed: tuple[str, ...] = ()) -> dict[str, str]:
    """The record of a file that is what was registered. needed: fields that it must have besides."""
    if name not in files:
        raise ProvenanceError(f"{name} is not registered")
    want = files[name]
    if lacking := [f for f in (*REQUIRED, *needed) if not want.get(f)]:
        raise ProvenanceError(f"{name}: the record lacks {', '.join(lacking)}")
    if (found := digest(spark, path)) != want["sha256"]:
        raise ProvenanceError(f"{name}: the digest is {found}, registered is {want['sha256']}")
    rows, columns = shape(spark, path)
    for key, have in (("rows", rows), ("cols", len(columns))):
        if want.get(key, "") not in NONE and int(want[key]) != have:
            raise ProvenanceError(f"{name}: {key} is {have}, registered is {want[key]}")
    pattern = want.get("columns_pattern", "")
    if pattern not in NONE and (odd := [c for c in columns if not re.fullmatch(pattern, c)]):
        raise ProvenanceError(f"{name}: columns {odd[:5]} aren't what was registered ({pattern})")
    return want
