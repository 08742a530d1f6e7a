"""Piles: the files of a target planned together, locked with their fingerprints, and read as one relation."""

from __future__ import annotations

import re
import statistics
import tomllib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark import session
from mudlark.plans import compiler, fit
from mudlark.plans.target import Target, TargetError, load
from mudlark.spec import ParseSpec, from_dict, to_dict, toml

OWN = (".mud.toml", ".mud.lock", ".mud.sql")


class DriftError(ValueError):
    """The pile isn't what was locked."""


@dataclass
class Report:
    target: str
    fits: list[fit.Fit] = field(default_factory=list)
    locked: bool = False
    flagged: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        out = []
        for f in self.fits:
            out.append(f"{Path(f.path).name}: {'fits' if f.spec else 'gap'}")
            out += [f"  {g.column}: {g.kind}: {g.why}" for g in f.gaps] + [f"  review: {r}" for r in f.reviews]
        return [*out, *self.flagged, "locked" if self.locked else "not locked"]

    def data(self) -> dict:
        return {"target": self.target, "locked": self.locked, "flagged": self.flagged, "members": [{"path": f.path, "fits": f.spec is not None, "gaps": [vars(g) for g in f.gaps], "reviews": f.reviews} for f in self.fits]}


def globbed(pattern: str) -> re.Pattern:
    """``*`` and ``?`` in the last part of a path."""
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern))


def members(target: Target) -> list[str]:
    """The target's files, sorted: globs less excludes, below the target's folder. An exclude that hits nothing is an error."""
    root = Path(target.path).resolve().parent
    found: dict[str, Path] = {}
    for pattern in target.files or ("*",):
        folder = (root / pattern).parent
        last = globbed(Path(pattern).name)
        for p in sorted(folder.iterdir()) if folder.is_dir() else []:
            if p.is_file() and last.fullmatch(p.name) and not p.name.endswith(OWN):
                real = session.inside(str(p), str(root))
                found[str(Path(pattern).parent / p.name)] = Path(real)
    for pattern in target.exclude:
        hits = [n for n in found if globbed(pattern).fullmatch(n) or globbed(pattern).fullmatch(Path(n).name)]
        if not hits and "#" not in pattern:
            raise TargetError(f"exclude {pattern!r} takes nothing away")
        for n in hits:
            del found[n]
    return sorted(found)


def lock_path(target: Target) -> Path:
    return Path(target.path.removesuffix(".mud.sql") + ".mud.lock")


def spec_id(spec: ParseSpec) -> str:
    import hashlib

    return hashlib.blake2b(toml(to_dict(spec)).encode(), digest_size=12).hexdigest()


def magnitudes(df: DataFrame, columns: list[str], rows: int = 2000) -> DataFrame:
    """(_member, column, median of absolute values, values) over the first rows of each member."""
    each = df.filter(F.col("_row") <= rows).select("_member", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.abs(F.col(c).cast("double")).alias("x")) for c in columns])).alias("s"))
    return each.filter("s.x is not null").groupBy("_member", F.col("s.c").alias("column")).agg(F.median("s.x").alias("median"), F.count("*").alias("n"))


def odd_magnitudes(rows: list[tuple[str, str, float, int]], factor: float = 10.0) -> list[str]:
    """Members whose median is ten times off the pile's, where three members or more have five values each."""
    out = []
    for column in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == column and r[3] >= 5]
        if len(own) < 3:
            continue
        middle = statistics.median(r[2] for r in own)
        out += [f"{m}: {column}: median {x:g} against {middle:g} in the pile" for m, _, x, _ in own if middle and x and not (1 / factor < x / middle < factor)]
    return out


def fit_pile(spark: SparkSession, path: str, write: bool = True) -> Report:
    """Plans all members and, only if all fit, writes the sidecars and the lock. Acceptances of unchanged members stay."""
    target = load(path)
    root = Path(path).resolve().parent
    report = Report(path)
    previous = read_lock(target)
    accepted = {m["path"]: m for m in previous["members"]} if previous else {}
    for name in members(target):
        file = str(root / name)
        if session.fresh(file) and not fit.conforms(session.load(file)[0], target):
            spec = session.load(file)[0]
            report.fits.append(fit.Fit(file, spec, reviews=fit.review(spec, target)))
            continue
        found = fit.plan(spark, file, target)
        if len(found) > 1:
            both = ", ".join(str(f.spec.extraction.pointer or f.spec.extraction.sheet) for f in found)
            found = [fit.Fit(file, None, [fit.Gap("Ambiguous", "*", f"several tables of the file fit: {both}")])]
        for f in found:
            if f.spec:
                wrong = fit.conforms(f.spec, target)
                if wrong:
                    f.gaps, f.spec = [fit.Gap("Untypable", "*", w) for w in wrong], None
        report.fits += found
    good = [f for f in report.fits if f.spec]
    numeric = [c.name for c in target.columns if c.dtype in ("int64", "float64", "decimal")]
    if len(good) >= 3 and numeric:
        df = union(spark, [(f.path, str(Path(f.path).relative_to(root)), f.spec) for f in good])
        report.flagged = odd_magnitudes([tuple(r) for r in magnitudes(df, numeric).collect()])
    if report.fits and len(good) == len(report.fits) and write:
        entries = []
        for f in good:
            name = str(Path(f.path).relative_to(root))
            reviews = f.reviews + [x for x in report.flagged if x.startswith(name + ":")]
            old = accepted.get(name)
            same = old is not None and old["hash"] == session.fingerprint(f.path) and old.get("reviews", []) == reviews
            entry = {"path": name, "hash": session.fingerprint(f.path), "bytes": Path(f.path).stat().st_size, "spec_id": spec_id(f.spec), "reviews": reviews, "accepted": bool(not reviews or (same and old.get("accepted")))}
            entries.append(entry)
            if target.plans != "lock":
                session.save(f.path, f.spec, by="fit")
        data: dict = {"version": 1, "target_hash": target.meaning(), "members": entries}
        if target.plans == "lock":
            data["plans"] = [{"id": i, "spec": to_dict(s)} for i, s in {spec_id(f.spec): f.spec for f in good}.items()]
        lock_path(target).write_text(toml(data))
        report.locked = True
    return report


def read_lock(target: Target) -> dict | None:
    p = lock_path(target)
    return tomllib.loads(p.read_text()) if p.exists() else None


def accept(path: str, member: str) -> None:
    """Marks a member's reviews as seen."""
    target = load(path)
    lock = read_lock(target)
    hits = [m for m in lock["members"] if m["path"] == member] if lock else []
    if not hits:
        raise DriftError(f"{member} isn't locked")
    hits[0]["accepted"] = True
    lock_path(target).write_text(toml(lock))


def drift(target: Target) -> list[str]:
    """How the pile differs from its lock."""
    lock = read_lock(target)
    if lock is None:
        return ["there is no lock; run fit"]
    if lock["target_hash"] != target.meaning():
        return ["the target changed since the lock was written"]
    out = []
    root = Path(target.path).resolve().parent
    locked = {m["path"]: m for m in lock["members"]}
    if len(locked) != len(lock["members"]):
        out.append("a member is locked twice")
    now = members(target)
    out += [f"{n}: added" for n in now if n not in locked]
    plans = {p["id"] for p in lock.get("plans", [])}
    for name, m in locked.items():
        file = root / name
        if name not in now:
            out.append(f"{name}: removed")
        elif file.stat().st_size != m["bytes"] or session.fingerprint(str(file)) != m["hash"]:
            out.append(f"{name}: changed")
        elif session.sidecar_path(str(file)).exists():
            if plans:
                out.append(f"{name}: a sidecar overrides the locked plan")
            elif spec_id(session.load(str(file))[0]) != m["spec_id"]:
                out.append(f"{name}: its spec was edited")
        elif not plans:
            out.append(f"{name}: its sidecar is gone")
    return out


def plans_of(target: Target) -> list[tuple[str, str, ParseSpec]]:
    """(path, name, spec) of the locked members in lock order; each plan is proved against the target again."""
    found = drift(target)
    if found:
        raise DriftError("; ".join(found))
    lock = read_lock(target)
    root = Path(target.path).resolve().parent
    waiting = [m["path"] for m in lock["members"] if not m["accepted"]]
    if waiting:
        raise DriftError(f"not reviewed yet: {', '.join(waiting)}")
    stored = {p["id"]: from_dict(p["spec"]) for p in lock.get("plans", [])}
    out = []
    for m in lock["members"]:
        spec = stored[m["spec_id"]] if stored else session.load(str(root / m["path"]))[0]
        wrong = fit.conforms(spec, target)
        if wrong:
            raise DriftError(f"{m['path']}: {'; '.join(wrong)}")
        out.append((str(root / m["path"]), m["path"], spec))
    return out


_VERIFIED: set[tuple[str, str]] = set()


def verified(spark: SparkSession, part: tuple[str, str, ParseSpec], frame=None) -> None:
    """Verifies a member, once for its bytes and spec."""
    path, name, spec = part
    key = (session.fingerprint(path), spec_id(spec))
    if key not in _VERIFIED:
        try:
            compiler.verify(frame or compiler.framed(spark, path, spec, name), spec)
        except compiler.VerifyError as e:
            raise compiler.VerifyError(f"{name}: {e}", e.faults) from e
        _VERIFIED.add(key)


def union(spark: SparkSession, parts: list[tuple[str, str, ParseSpec]], provenance: bool = True) -> DataFrame:
    """Members as one relation, with ``_member`` and ``_row`` for provenance; each is verified once for its bytes and spec.

    Members of one spec and header are one branch of the plan and one job of verification, however many they are.
    """
    out = []
    many = [p for p in parts if compiler.together(p[2])]
    for frame, spec, own in compiler.framed_together(spark, many) if many else []:
        keys = {(session.fingerprint(p), spec_id(s)): name for p, name, s in own}
        if not _VERIFIED.issuperset(keys):
            for name in sorted(compiler.faulty(frame, spec)):
                verified(spark, next(p for p in own if p[1] == name))
            _VERIFIED.update(keys)
        out.append(compiler.typed(frame, spec, provenance))
    for part in parts:
        if not compiler.together(part[2]):
            frame = compiler.framed(spark, part[0], part[2], part[1])
            verified(spark, part, frame)
            out.append(compiler.typed(frame, part[2], provenance))
    return reduce(DataFrame.unionByName, out)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The locked pile of a target. Order is by ``_member`` and ``_row`` where the target asks for provenance; else none is promised."""
    target = load(path)
    parts = plans_of(target)
    if not parts:
        raise DriftError("the lock has no members")
    df = union(spark, parts, target.provenance)
    names = [c.name for c in target.columns]
    return df.select(*names, "_member", "_row") if target.provenance else df.select(*names)
