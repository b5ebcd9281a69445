"""Manifests and lockfiles: TOML texts as nested columns. Only the parsing is Python; all else is relational."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# The dependency tables of a manifest, and the kind each holds.
TABLES = {
    "dependencies": "normal",
    "dev-dependencies": "development",
    "dev_dependencies": "development",
    "build-dependencies": "build",
    "build_dependencies": "build",
}
TEXT_FIELDS = ("version", "package", "git", "path", "registry")
DEPENDENCY = (
    "alias: string, kind: string, target: string, version: string, package: string, git: string, local: string, "
    "registry: string, optional: boolean, inherited: boolean"
)
DIAGNOSTICS = "diagnostics array<struct<code: string, message: string>>"
MANIFEST = (
    f"package string, workspace string, is_root boolean, rust_version string, rust_inherited boolean, root_rust_version string, "
    f"templates array<struct<{DEPENDENCY}>>, declarations array<struct<{DEPENDENCY}>>, {DIAGNOSTICS}, parsed boolean"
)
LOCK = (
    "packages array<struct<node: int, name: string, version: string, source: string>>, "
    "edges array<struct<src: int, dst: int>>, legacy_root boolean, buildable boolean, error string"
)


def _dependency(alias: str, kind: str, target: str | None, spec, notes: list, template: bool = False) -> dict | None:
    row = dict.fromkeys(("version", "package", "git", "local", "registry", "optional"))
    row |= {"alias": alias, "kind": kind, "target": target, "inherited": False}
    if isinstance(spec, str):
        return row | {"version": spec}
    if not isinstance(spec, dict):
        notes.append(("invalid_dependency_declaration", f"{alias}: neither a text nor a table"))
        return None
    for name, type_ in [*((n, str) for n in TEXT_FIELDS), ("optional", bool), ("workspace", bool)]:
        value = spec.get(name)
        if value is not None and not isinstance(value, type_):
            notes.append(("invalid_dependency_field", f"{alias}.{name} is not a {type_.__name__}"))
            value = None
        if name == "workspace":
            row["inherited"] = bool(value)
        else:  # a dependency's path is `local`, apart from the manifest's
            row["local" if name == "path" else name] = value
    if row["inherited"] and not template and any(spec.get(n) is not None for n in TEXT_FIELDS):
        notes.append(("workspace_dependency_override", f"{alias} is inherited and has fields of its own"))
    return row


def _flattened(table: dict, target: str | None, notes: list) -> list[dict]:
    rows = []
    for name, kind in TABLES.items():
        found = table.get(name)
        if isinstance(found, dict):
            rows += [r for alias, spec in found.items() if (r := _dependency(alias, kind, target, spec, notes))]
    return rows


def parse_manifest(text: str | None) -> dict:
    """The columns of MANIFEST for one text."""
    out = {"package": None, "workspace": None, "is_root": False, "rust_version": None, "rust_inherited": False}
    out |= {"root_rust_version": None, "templates": [], "declarations": [], "diagnostics": [], "parsed": False}
    notes: list[tuple[str, str]] = []
    try:
        doc = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError as e:
        return out | {"diagnostics": [{"code": "manifest_parse_error", "message": str(e)}]}
    package = doc.get("package") if isinstance(doc.get("package"), dict) else {}
    root = doc.get("workspace") if isinstance(doc.get("workspace"), dict) else None
    as_text = lambda v: v if isinstance(v, str) else None
    rust = package.get("rust-version")
    out |= {
        "package": as_text(package.get("name")),
        "workspace": as_text(package.get("workspace")),
        "is_root": root is not None,
        "rust_version": as_text(rust),
        "rust_inherited": isinstance(rust, dict) and rust.get("workspace") is True,
        "parsed": True,
    }
    if root is not None:
        shared = root.get("dependencies")
        found = [_dependency(alias, "normal", None, spec, notes, template=True) for alias, spec in (shared.items() if isinstance(shared, dict) else ())]
        notes += [("invalid_workspace_dependency", f"{r['alias']} is a template and cannot itself be inherited") for r in found if r and r["inherited"]]
        out["templates"] = [r for r in found if r and not r["inherited"]]
        out["root_rust_version"] = as_text((root.get("package") or {}).get("rust-version")) if isinstance(root.get("package"), dict) else None
    out["declarations"] = _flattened(doc, None, notes)
    targets = doc.get("target")
    for selector, table in (targets.items() if isinstance(targets, dict) else ()):
        if isinstance(table, dict):
            out["declarations"] += _flattened(table, selector, notes)
    out["diagnostics"] = [{"code": c, "message": m} for c, m in notes]
    return out


_REFERENCE = re.compile(r"^(\S+)(?: (\S+))?(?: \(([^)]*)\))?$")


# Lockfiles as the tool itself writes them: whoever edits one may write any TOML, which the TOML parser then reads.
_PLAIN = "[ !#-\\[\\]-~]*"
_PACKAGE = re.compile(
    rf'\[\[package\]\]\nname = "({_PLAIN})"\nversion = "({_PLAIN})"\n(?:source = "({_PLAIN})"\n)?(?:checksum = "{_PLAIN}"\n)?'
    rf'(?:dependencies = \[((?:"{_PLAIN}"(?:, "{_PLAIN}")*|\n(?: "{_PLAIN}",\n)+)?)\]\n)?\n*'
)
_HEAD = re.compile(r"(?:#[ -~]*\n|\n)*(?:version = [1-9][0-9]*\n)?\n*")
_QUOTED = re.compile('"([^"]*)"')


def _written_by_tool(text: str) -> list[tuple] | None:
    """(name, version, source, dependencies) of each package if the text has, from end to end, the form the tool writes."""
    found = _PACKAGE.split(text)
    if len(found) == 1 or any(found[5::5]) or not _HEAD.fullmatch(found[0]):
        return None
    return [(n, v, s, _QUOTED.findall(d) if d else ()) for n, v, s, d in zip(found[1::5], found[2::5], found[3::5], found[4::5], strict=True)]


def _lock_of(text: str | None) -> tuple[list[tuple], list[tuple], bool, bool, str | None]:
    """(packages, edges, legacy_root, buildable, error): packages are (name, version, source), edges (src, dst) of their places."""
    listed, legacy_root = _written_by_tool(text or ""), False
    if listed is None:
        try:
            doc = tomllib.loads(text or "")
            given = [p for p in doc.get("package", []) if isinstance(p, dict)]
            if isinstance(doc.get("root"), dict):
                legacy_root = True
                given = [doc["root"], *given]
            listed = [(p["name"], p["version"], p.get("source"), p.get("dependencies", [])) for p in given]
        except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
            return [], [], legacy_root, False, f"lockfile does not parse: {e}"
    by_name: dict[str, list[int]] = {}
    for k, p in enumerate(listed):
        by_name.setdefault(p[0], []).append(k)
    edges, buildable = [], True
    for k, (_, _, _, references) in enumerate(listed):
        for reference in references:
            match = _REFERENCE.match(str(reference))
            name, version, source = match.groups() if match else (None, None, None)
            fits = [q for q in by_name.get(name, ()) if version in (None, listed[q][1]) and source in (None, listed[q][2])]
            if len(fits) == 1:
                edges.append((k, fits[0]))
            else:
                buildable = False
    return [p[:3] for p in listed], edges, legacy_root, buildable, None


def parse_lock(text: str | None) -> dict:
    """The columns of LOCK for one text; an edge names its package, with version and source where needed."""
    packages, edges, legacy_root, buildable, error = _lock_of(text)
    return {
        "packages": [{"node": k, "name": n, "version": v, "source": s} for k, (n, v, s) in enumerate(packages)],
        "edges": [{"src": a, "dst": b} for a, b in edges], "legacy_root": legacy_root, "buildable": buildable, "error": error,
    }


def _structs(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, column by column."""
    ends = np.cumsum([0, *map(len, rows)]).astype("int32")
    columns = zip(*chain.from_iterable(rows)) if ends[-1] else ([] for _ in fields)
    struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(ends), struct)


def _parsed(df: DataFrame, keys: list[str], text_col: str, parse, schema: str) -> DataFrame:
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([parse(t) for t in batch[text_col]], index=batch.index)
            if len(batch):
                yield pd.concat([batch[keys], found], axis=1)

    return df.select(*keys, text_col).mapInPandas(rows, f"{kinds}, {schema}")


def manifests(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the columns of MANIFEST; a text that does not parse is a row with a diagnostic."""
    return _parsed(df, keys, text_col, parse_manifest, MANIFEST)


def lockfiles(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the columns of LOCK; a text that does not parse is a row with an error."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    package = {"node": pa.int32(), "name": pa.string(), "version": pa.string(), "source": pa.string()}
    edge = {"src": pa.int32(), "dst": pa.int32()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packages, edges, *flags = zip(*map(_lock_of, batch.column(len(keys)).to_pylist())) if len(batch) else ((),) * 5
            numbered = [[(k, *p) for k, p in enumerate(some)] for some in packages]
            columns = [_structs(numbered, package), _structs(edges, edge), *map(pa.array, flags, (pa.bool_(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, "packages", "edges", "legacy_root", "buildable", "error"])

    return df.select(*keys, text_col).mapInArrow(rows, f"{kinds}, {LOCK}")
