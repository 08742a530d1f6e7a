"""Spark SQL over messy files: binds ``messy()`` and ``dataset()`` to verified views."""

from __future__ import annotations

import hashlib
import tempfile
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mudlark import sqlscan
from mudlark.spec import ParseSpec, SpecError, from_dict, to_dict, toml

SUFFIX = ".mud.toml"


class StaleError(ValueError):
    """A frozen query meets a file without a fresh sidecar."""


def ship(spark: SparkSession) -> None:
    """Makes the package importable by Python workers; done once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_mudlark_core", False):
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="mudlark-")) / "mudlark_core.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent).as_posix())
    context.addPyFile(str(packed))
    context._mudlark_core = True


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the semantics rely on."""
    for k, v in {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.legacy.timeParserPolicy": "CORRECTED", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "65536"}.items():
        spark.conf.set(k, v)
    return spark


_HASHES: dict[tuple[str, int, int], str] = {}


def fingerprint(path: str) -> str:
    """A hash of a file's bytes, kept by path, size and time of change."""
    s = Path(path).stat()
    key = (str(path), s.st_size, s.st_mtime_ns)
    if key not in _HASHES:
        h = hashlib.blake2b(digest_size=32)
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        _HASHES[key] = f"b2:{h.hexdigest()}"
    return _HASHES[key]


def sidecar_path(path: str, member: str = "") -> Path:
    """Where a file's spec is kept; ``member`` is #sheet or #2 for one of several tables in it."""
    return Path(f"{path}{member}{SUFFIX}")


def save(path: str, spec: ParseSpec, member: str = "", by: str = "sniff") -> Path:
    out = sidecar_path(path, member)
    data = {"version": 1, "source": {"path": Path(path).name, "hash": fingerprint(path), "bytes": Path(path).stat().st_size}, "provenance": {"by": by}, "spec": to_dict(spec)}
    out.write_text(toml(data))
    return out


def load(path: str, member: str = "") -> tuple[ParseSpec, dict]:
    data = tomllib.loads(sidecar_path(path, member).read_text())
    unknown = set(data) - {"version", "source", "provenance", "spec"}
    if unknown or data.get("version") != 1:
        raise SpecError(f"a sidecar of another kind: {sorted(unknown) or data.get('version')}")
    return from_dict(data["spec"]), data["source"]


def fresh(path: str, member: str = "") -> bool:
    return sidecar_path(path, member).exists() and load(path, member)[1]["hash"] == fingerprint(path)


def stamp(spark: SparkSession, path: str, member: str = "") -> ParseSpec:
    """Proves a spec that was edited by hand against its file, and records the file's fingerprint anew."""
    from mudlark.plans import compiler

    spec, _ = load(path, member)
    compiler.verify(compiler.framed(spark, path, spec), spec)
    save(path, spec, member, by="hand")
    return spec


def inside(path: str, root: str | None) -> str:
    """The path, if it lies below the root once links are followed."""
    real = Path(path).resolve()
    if root is not None and not real.is_relative_to(Path(root).resolve()):
        raise PermissionError(f"{path} lies outside {root}")
    return str(real)


class Session:
    """Queries over files. ``frozen``: only fresh sidecars, nothing inferred or written. ``root``: no file outside it."""

    def __init__(self, spark: SparkSession, frozen: bool = False, root: str | None = None, write: bool = True):
        self.spark = configure(spark)
        self.frozen, self.root, self.write = frozen, root, write and not frozen
        self._views: dict[tuple, str] = {}
        self.notes: list[str] = []

    def spec(self, path: str, hint: str | None = None) -> ParseSpec:
        return self.found(path, hint)[0]

    def found(self, path: str, hint: str | None = None):
        """A file's spec, and its frame if the spec was just inferred and proven on it."""
        from mudlark.plans import sniff

        if hint is None and sidecar_path(path).exists():
            if fresh(path):
                return load(path)[0], None
            if self.frozen:
                raise StaleError(f"{path} changed since its sidecar was written")
        if self.frozen:
            raise StaleError(f"{path} has no sidecar")
        found, frame = sniff.proven(self.spark, path, hint)
        self.notes += [f"{path}: {n}" for n in found.notes]
        if found.confidence < 0.8:
            self.notes.append(f"{path}: read with confidence {found.confidence:.2f}")
        if self.write and hint is None:
            save(path, found)
        return found, frame

    def table(self, path: str, hint: str | None = None) -> DataFrame:
        from mudlark.plans import compiler

        path = inside(path, self.root)
        spec, frame = self.found(path, hint)
        return compiler.table(self.spark, path, spec) if frame is None else compiler.typed(frame, spec.validate())

    def dataset(self, target: str) -> DataFrame:
        from mudlark.plans import pile

        return pile.dataset(self.spark, inside(target, self.root))

    def _view(self, r: sqlscan.Reference) -> str:
        key = (r.function, str(Path(r.path).resolve()), r.hint)
        if key not in self._views:
            df = self.table(r.path, r.hint) if r.function == "messy" else self.dataset(r.path)
            name = f"mudlark_{len(self._views)}_{hashlib.md5(str(key).encode()).hexdigest()[:8]}"
            df.createOrReplaceTempView(name)
            self._views[key] = name
        return self._views[key]

    def sql(self, text: str) -> DataFrame:
        """Plain Spark SQL; the two table functions become views, each file bound once a session."""
        return self.spark.sql(sqlscan.rewrite(text, self._view))
