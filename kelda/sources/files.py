"""Reading feeds: header names resolved, encodings decided, archives unpacked, scans counted."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class SchemaMismatch(ValueError):
    """A required column is missing; the message lists the header that was found."""


def resolve_columns(found: list[str], wanted: dict[str, list[str]], required: set[str], label: str) -> dict[str, str | None]:
    """Header of each logical field: its first candidate that is present, whatever the case and spacing.

    A required field without one raises, an optional one is None.
    """
    def plain(x: str) -> str:
        return " ".join(x.replace("﻿", "").split()).lower()

    present = {}
    for c in found:
        present.setdefault(plain(c), c)
    out = {name: next((present[plain(c)] for c in options if plain(c) in present), None) for name, options in wanted.items()}
    missing = sorted(n for n in required if out.get(n) is None)
    if missing:
        raise SchemaMismatch(f"{label}: no column for {', '.join(missing)}; the header is {found}")
    return out


def read_feed(spark: SparkSession, path: str, wanted: dict[str, list[str]], required: set[str], encoding: str = "UTF-8", bad_rows: str = "PERMISSIVE") -> DataFrame:
    """A CSV feed as strings under logical names; quoted fields may hold line ends. Missing optional fields are NULL.

    Nothing is inferred, so the file is read once and a value is never reshaped.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, mode=bad_rows, inferSchema=False)
    names = resolve_columns(raw.columns, wanted, required, path)
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in names.items()])


def shape_as(rows: DataFrame, columns: dict[str, Column | str | None]) -> DataFrame:
    """rows in a common vocabulary of strings: each name with its column, expression, or NULL. For ``unionByName``."""
    def one(c: Column | str | None) -> Column:
        return F.lit(None) if c is None else F.col(f"`{c}`") if isinstance(c, str) else c

    return rows.select(*[one(c).cast("string").alias(n) for n, c in columns.items()])


def decide_encoding(raw: bytes) -> tuple[str, int]:
    """(encoding, damaged characters): strict UTF-8, else Windows-1252, else UTF-8 with replacements counted."""
    try:
        raw.decode("utf-8-sig")
        return "utf-8-sig", 0
    except UnicodeDecodeError:
        pass
    try:
        raw.decode("cp1252")
        return "cp1252", 0
    except UnicodeDecodeError:
        return "utf-8", raw.decode("utf-8", "replace").count("�")


def check_archive(path: str) -> None:
    """Raises unless the file is a ZIP archive; says so where a web page was saved instead."""
    with open(path, "rb") as f:
        head = f.read(512)
    if head.lstrip().lower().startswith((b"<!doctype html", b"<html")):
        raise ValueError(f"{path} is a web page, not an archive")
    if not zipfile.is_zipfile(path):
        raise ValueError(f"{path} is no ZIP archive")


def unpack_members(path: str, members: list[str], landing: str) -> dict[str, str]:
    """Writes the wanted members, by base name in any case, to the landing folder as UTF-8; member to path.

    Members are streamed, so an archive may be larger than memory; one that is missing raises.
    """
    check_archive(path)
    os.makedirs(landing, exist_ok=True)
    out = {}
    with zipfile.ZipFile(path) as z:
        by_name = {os.path.basename(n).lower(): n for n in z.namelist() if not n.endswith("/")}
        for m in members:
            inner = by_name.get(m.lower())
            if inner is None:
                raise SchemaMismatch(f"{path} has no member {m}; it has {sorted(by_name)}")
            target = os.path.join(landing, m)
            # A byte anywhere may tell, so UTF-8 is tried on all of the member before another encoding is.
            for encoding, errors in (("utf-8-sig", "strict"), ("cp1252", "strict"), ("utf-8-sig", "replace")):
                try:
                    with z.open(inner) as f, open(target, "w", encoding="utf-8", newline="") as to:
                        text = io.TextIOWrapper(f, encoding=encoding, errors=errors, newline="")
                        while part := text.read(1 << 20):
                            to.write(part)
                    break
                except UnicodeDecodeError:
                    continue
            out[m] = target
    return out


def file_provenance(path: str, url: str | None = None) -> dict[str, object]:
    """Digest, size and time of a file, for the meta row beside a table."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    s = os.stat(path)
    return {"path": path, "url": url, "sha256": h.hexdigest(), "bytes": s.st_size, "modified": int(s.st_mtime)}


@dataclass(frozen=True)
class Validators:
    """What a server said of a feed, kept beside it; empty where unreadable."""

    etag: str | None = None
    last_modified: str | None = None

    @staticmethod
    def read(path: str) -> Validators:
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            return Validators(found.get("etag"), found.get("last_modified"))
        except (OSError, ValueError, AttributeError):
            return Validators()

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"etag": self.etag, "last_modified": self.last_modified}, f)


def pages(fetch, size: int = 100, most: int | None = None) -> Iterator[dict]:
    """Records of a paged source: ``fetch(start, rows)`` gives (total, records), until all or ``most`` are read."""
    start = 0
    while True:
        total, records = fetch(start, size)
        for r in records:
            if most is not None and start >= most:
                return
            start += 1
            yield r
        if not records or start >= total:
            return


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All daily snapshots of a feed with their day, from the partition folders."""
    return spark.read.parquet(path)


def scan_counts(rows: DataFrame, key: str, title: str) -> DataFrame:
    """Per key its rows and a title: two columns of the scan, reduced before the shuffle."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(F.when(F.trim(title) != "", F.col(title))).alias("title"))


def resume_download(read: Callable[[int, int], bytes], path: str, size: int, part: int = 1 << 20) -> int:
    """Fetches ``size`` bytes by ``read(start, length)`` into ``path``; gives how many were fetched now.

    What an interrupted call has left in ``path.part`` is kept and continued; the file gets
    its name only when it is whole. A file of the wrong size, left over from another
    source, is begun anew; a read that gives nothing before the end raises.
    """
    if os.path.exists(path) and os.path.getsize(path) == size:
        return 0
    held = f"{path}.part"
    have = os.path.getsize(held) if os.path.exists(held) else 0
    if have > size:
        have = 0
    start = have
    with open(held, "r+b" if have else "wb") as f:
        f.seek(have)
        while have < size:
            got = read(have, min(part, size - have))
            if not got:
                raise OSError(f"{path}: the source ended after {have} of {size} bytes")
            f.write(got)
            have += len(got)
    os.replace(held, path)
    return have - start
