"""Build manifests: name, version and dependencies of the packages of a corpus."""

from __future__ import annotations

import json
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import names

DEPENDENCIES = 10
ORDER = ["Cargo.toml", "package.json", "go.mod", "pyproject.toml"]


def parse(path: str, content: str) -> tuple[str | None, str | None, list[str]]:
    """(name, version, first dependencies in order) of a manifest; nothing of one that does not parse."""
    base = path.rsplit("/", 1)[-1]
    name = version = None
    needs: list[str] = []
    try:
        if base == "package.json":
            data = json.loads(content)
            name, version, needs = data.get("name"), data.get("version"), list(data.get("dependencies") or {})
        elif base == "go.mod":
            found = re.search(r"^module\s+(\S+)", content, re.M)
            name = found[1] if found else None
            blocks = " ".join(re.findall(r"require\s*\(([^)]*)\)", content)) if "(" in content else ""
            needs = [m[1] for m in re.finditer(r"(?:^|\s)([\w./-]+\.[\w./-]+)\s+v\d", blocks)] + re.findall(r"^require\s+(\S+)\s+v", content, re.M)
        else:
            data = tomllib.loads(content)
            own = data.get("package") or data.get("project") or (data.get("tool") or {}).get("poetry") or {}
            name, version = own.get("name"), own.get("version")
            wanted = data.get("dependencies") or own.get("dependencies") or {}
            needs = [re.split(r"[\s<>=!~;\[(]", d)[0] for d in wanted] if isinstance(wanted, list) else [d for d in wanted if d != "python"]
    except (ValueError, AttributeError, TypeError):
        return None, None, []
    text = lambda x: x if isinstance(x, str) else None
    return text(name), text(version), sorted(set(needs))[:DEPENDENCIES]


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, dependencies) of the manifests among ``files`` (path, content)."""

    def run(batches):
        for batch in batches:
            rows = [(p, *parse(p, c or "")) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "name", "version", "dependencies"])

    own = files.where(names.basename(F.col("path")).isin(ORDER)).select("path", "content")
    return own.mapInArrow(run, "path string, name string, version string, dependencies array<string>")


def first_manifest(files: DataFrame, folder: str = "") -> DataFrame:
    """The manifest of a folder that counts, if it has several."""
    rank = F.array_position(F.array(*[F.lit(n) for n in ORDER]), names.basename(F.col("path")))
    return files.where((names.parent(F.col("path")) == folder) & (rank > 0)).orderBy(rank).limit(1)
