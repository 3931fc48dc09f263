"""Settings that change while a capture runs: versions by event time, and stages that run once for each setting of their own section.

A change is a row (valid_from, section, settings): some of a section's values from a time on.  All changes up to a time make a version; a frame
is computed under the version that its own time falls into, in a table as well as in a stream, so a replay gives what the stream gave.
A stage reads one section: versions that agree in it share its run, and a change of another section leaves it alone.

Settings as files are YAML where that library is there, else JSON, which YAML readers take as well.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cfar import Cfar
from .peaks import Peaks, detect
from .spectral import Welch, welch

#: Changes of a run at most; they become a literal of the plan.
MOST = 1000
CHANGES = "valid_from timestamp, section string, settings map<string,string>"
#: Sections and what their values make.
SECTIONS = {"spectrum": Welch, "cfar": Cfar, "peaks": Peaks}
#: Bundles of changes by name.
PRESETS: dict[str, dict[str, dict[str, str]]] = {
    "survey": {"spectrum": {"fft_size": "1024", "overlap": "0.5"}, "cfar": {"reference": "32", "guard": "4", "pfa": "1e-6"}},
    "sensitive": {"spectrum": {"fft_size": "4096", "overlap": "0.75"}, "cfar": {"reference": "64", "guard": "8", "pfa": "1e-4"}},
}


def made(section: str, settings: dict[str, str]):
    """The section's object; an unknown section or name, or a value out of range, is a ValueError."""
    if section not in SECTIONS:
        raise ValueError(f"no section {section}; there are {', '.join(SECTIONS)}")
    kinds = {f.name: f.type for f in fields(SECTIONS[section])}
    out = {}
    for name, value in settings.items():
        if name not in kinds:
            raise ValueError(f"{section} has no setting {name}")
        kind = str(kinds[name])
        if "bool" in kind:
            if str(value).lower() not in ("true", "false"):
                raise ValueError(f"{section}.{name} is true or false")
            out[name] = str(value).lower() == "true"
        else:
            out[name] = int(value) if "int" in kind else float(value) if "float" in kind else str(value)
    try:
        return SECTIONS[section](**out)
    except TypeError as e:  # a value without a default is missing
        raise ValueError(f"{section}: {e}") from e


@dataclass(frozen=True)
class Versions:
    """``starts`` in microseconds, ascending, and the sections of each version; version 0 is what held before the first change."""

    starts: tuple[int, ...]
    sections: tuple[dict[str, dict[str, str]], ...]

    @classmethod
    def of(cls, base: dict[str, dict[str, str]], changes: list[tuple[int, str, dict[str, str]]]) -> Versions:
        """From the first settings and changes (microseconds, section, values); changes of one time are one version, later rows of a section win by name."""
        starts, sections = [], [{k: dict(v) for k, v in base.items()}]
        for at, section, values in sorted(changes, key=lambda c: (c[0], c[1], sorted(c[2].items()))):
            if not starts or starts[-1] != at:
                starts.append(at)
                sections.append({k: dict(v) for k, v in sections[-1].items()})
            sections[-1].setdefault(section, {}).update(values)
        for own in sections:
            for section, values in own.items():
                made(section, values)
        return cls(tuple(starts), tuple(sections))

    @classmethod
    def read(cls, changes: DataFrame, base: dict[str, dict[str, str]]) -> Versions:
        """From a table of changes; a row without a time, section or values is no change."""
        rows = changes.where("valid_from IS NOT NULL AND section IS NOT NULL AND settings IS NOT NULL").select(F.unix_micros("valid_from").alias("at"), "section", "settings").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} changes; read those of one run")
        return cls.of(base, [(r["at"], r["section"], {k: v for k, v in r["settings"].items() if v is not None}) for r in rows])

    def at(self, micros: int) -> int:
        return bisect_right(self.starts, micros)

    def number(self, ts: str) -> Column:
        """The version of a row by its timestamp column; 0 for a null."""
        return self.number_of(F.unix_micros(ts))

    def number_of(self, micros: Column) -> Column:
        """The version of a row by its time in microseconds."""
        starts = F.array(*(F.lit(x) for x in self.starts)).cast("array<bigint>")
        return F.when(micros.isNull(), 0).otherwise(F.size(F.filter(starts, lambda x: x <= micros)))

    def settings(self, *names: str) -> list[tuple[tuple, list[int]]]:
        """The different objects of these sections taken together, and the versions that have them."""
        out: dict[tuple, list[int]] = {}
        for k, own in enumerate(self.sections):
            out.setdefault(tuple(made(n, own.get(n, {})) for n in names), []).append(k)
        return list(out.items())

    def staged(self, df: DataFrame, names: tuple[str, ...], stage: Callable[..., DataFrame]) -> DataFrame:
        """``stage(rows, *objects)`` for each different setting of the sections, over the rows (with ``version``) that have it."""
        parts = [stage(df.where(F.col("version").isin(own)), *objects) for objects, own in self.settings(*names)]
        return reduce(DataFrame.unionByName, parts)


def detect_versions(blocks: DataFrame, versions: Versions, ts: str = "ts", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Detections of blocks (ts, i, q and ``keep``), each under the settings of its own time, with ``version``."""
    kept = (*keep, "version")
    rows = blocks.withColumn("version", versions.number(ts))
    spectra = versions.staged(rows, ("spectrum",), lambda part, spec: welch(part, spec, kept))
    return versions.staged(spectra, ("cfar", "peaks"), lambda part, cfar, peaks: detect(part, cfar, peaks, keep=kept))


def detect_stream(blocks: DataFrame, changes: Callable[[SparkSession], DataFrame], base: dict[str, dict[str, str]], path: str, checkpoint: str, ts: str = "ts", keep: tuple[str, ...] = ("seq",)):
    """A streaming query that writes detections under ``path``; each micro-batch reads the changes anew, so one counts from the next batch on, for rows from its time on."""

    def run(batch: DataFrame, number: int) -> None:
        found = detect_versions(batch, Versions.read(changes(batch.sparkSession), base), ts, keep)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return blocks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed(before: dict[str, dict[str, str]], after: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """The values of ``after`` that differ from ``before``, by section; sections without a change are left out."""
    out = {s: {k: v for k, v in values.items() if before.get(s, {}).get(k) != v} for s, values in after.items()}
    return {s: v for s, v in out.items() if v}


def preset(spark: SparkSession, name: str, valid_from: str, current: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The changes that a preset makes at a time (of those that differ from ``current``)."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {', '.join(PRESETS)}")
    rows = list(changed(current or {}, PRESETS[name]).items())
    return spark.createDataFrame(rows, "section string, settings map<string,string>").select(F.lit(valid_from).cast("timestamp").alias("valid_from"), "section", "settings")


def to_text(settings: dict[str, dict[str, str]]) -> str:
    """Settings as a file's text."""
    try:
        import yaml
    except ImportError:
        return json.dumps(settings, indent=2)
    return yaml.safe_dump(settings, default_flow_style=False)


def from_text(text: str) -> dict[str, dict[str, str]]:
    """Whole settings from a file's text; sections and names that no stage knows, missing values and those out of range are a ValueError."""
    try:
        import yaml

        given = yaml.safe_load(text)
    except ImportError:
        given = json.loads(text)
    if given is None:
        given = {}
    if not isinstance(given, dict) or not all(isinstance(v, dict) for v in given.values()):
        raise ValueError("settings are sections of names and values")
    out = {s: {k: str(v) for k, v in values.items()} for s, values in given.items()}
    for section, values in out.items():
        made(section, values)
    return out
