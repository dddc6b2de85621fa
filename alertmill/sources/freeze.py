"""Frozen outputs: a table as one sorted text file whose bytes depend on its rows alone, its SHA-256, and what changed since."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.scalar import spreadsheet_safe
from alertmill.sources import scratch

CHUNK = 1 << 20


def cell(column: Column, kind: str, guard: bool = False) -> Column:
    """A value as text: UTC ISO times, true and false, lists joined by commas, null as nothing; quoted only where CSV needs it.
    guard: what a spreadsheet would run as a formula gets a quote in front."""
    if kind == "timestamp":
        text = F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    elif kind.startswith("array"):
        text = F.array_join(column.cast("array<string>"), ",")
    else:
        text = column.cast("string")
    text = F.coalesce(text, F.lit(""))
    text = spreadsheet_safe(text) if guard else text
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(df: DataFrame, columns: Sequence[str], guard: bool = False) -> Column:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.array_join(F.array(*(cell(F.col(c), kinds[c], guard) for c in columns)), ",")


def export(df: DataFrame, path: str, name: str, keys: Sequence[str]) -> dict:
    """As freeze(), for spreadsheets: behind a byte order mark, lines ended by CR LF, cells that would be formulas guarded."""
    return freeze(df, path, name, keys, line_end="\r\n", mark="\ufeff", guard=True)


def freeze(df: DataFrame, path: str, name: str, keys: Sequence[str], line_end: str = "\n", mark: str = "", guard: bool = False) -> dict:
    """Writes df as path/name (CSV with a header, line feeds, rows sorted by keys and then by all columns) and returns its entry
    of the manifest: name, rows, bytes and sha256. Tasks sort and write parts of the order; the parts are joined as a stream, in
    pieces of CHUNK bytes. The file is one: use this for outputs that people keep, not for tables."""
    from pyarrow import fs

    columns = df.columns
    body = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), lines(df, columns, guard).alias("value")).orderBy(*(f"k{i}" for i in range(len(keys))), "value").select("value")
    parts = scratch.path(df.sparkSession, "freeze")
    body.write.option("lineSep", line_end).text(parts)
    store, folder = fs.FileSystem.from_uri(parts)
    target, place = fs.FileSystem.from_uri(path)
    target.create_dir(place, recursive=True)
    digest, size = hashlib.sha256(), 0
    with target.open_output_stream(f"{place}/{name}") as out:
        header = (mark + ",".join(columns) + line_end).encode()
        for piece in _pieces(store, folder, header):
            out.write(piece)
            digest.update(piece)
            size += len(piece)
    return {"name": name, "rows": df.count(), "bytes": size, "sha256": digest.hexdigest()}


def _pieces(store, folder: str, header: bytes):
    from pyarrow import fs

    yield header
    for f in sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-")):
        with store.open_input_stream(f) as part:
            while piece := part.read(CHUNK):
                yield piece


def manifest(path: str, entries: Sequence[dict]) -> str:
    """Writes path/manifest.json, sorted by name, and returns its text."""
    from pyarrow import fs

    text = json.dumps(sorted(entries, key=lambda e: e["name"]), sort_keys=True, indent=1) + "\n"
    target, place = fs.FileSystem.from_uri(path)
    with target.open_output_stream(f"{place}/manifest.json") as out:
        out.write(text.encode())
    return text


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change (added, removed, changed) and the names of the columns that differ, for every row that is not the same in
    both versions. Nulls are equal; a column that one version lacks counts as null there."""
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    side = lambda df, s: df.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names), F.lit(True).alias("_there")).alias(s))
    both = side(old, "a").join(side(new, "b"), list(keys), "full_outer")
    differ = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in names)), lambda c: c.isNotNull())
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("columns")).filter("change is not null")
