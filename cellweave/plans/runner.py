"""A runner of named stages, each a function from earlier outputs to a DataFrame that is written once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    """``make(read)`` returns the stage's rows, where ``read(name)`` opens an earlier stage; ``check(df)`` lists faults."""

    name: str
    make: Callable[[Callable[[str], DataFrame]], DataFrame]
    check: Callable[[DataFrame], list[str]] = field(default=lambda df: [])


class Runner:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def done(self, name: str) -> bool:
        """Whether a stage's output is complete."""
        return self._store().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name), "_SUCCESS"))

    def chosen(self, start: str | None = None, only: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> list[Stage]:
        names = [s.name for s in self.stages]
        unknown = {*only, *skip, *([start] if start else [])} - set(names)
        if unknown:
            raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
        after = self.stages[names.index(start) :] if start else self.stages
        return [s for s in after if (not only or s.name in only) and s.name not in skip]

    def clean_from(self, start: str) -> list[str]:
        """Delete the outputs of a stage and of all after it; returns their names."""
        gone = [s.name for s in self.chosen(start) if self._store().exists(self._path(s.name))]
        for name in gone:
            self._store().delete(self._path(name), True)
        return gone

    def validate(self, **which) -> dict[str, list[str]]:
        return {s.name: s.check(self.read(s.name)) if self.done(s.name) else ["no output"] for s in self.chosen(**which)}

    def run(self, dry: bool = False, clean: bool = False, validate: bool = False, **which) -> list[tuple[str, str]]:
        """(stage, what happened) in order: planned, kept (its output is complete), written; a fault stops the run."""
        stages = self.chosen(**which)
        if clean and stages and not dry:
            self.clean_from(stages[0].name)
        out = []
        for s in stages:
            if dry:
                out.append((s.name, "planned"))
            elif self.done(s.name):
                out.append((s.name, "kept"))
            else:
                s.make(self.read).write.mode("overwrite").parquet(f"{self.root}/{s.name}")
                out.append((s.name, "written"))
            if validate and not dry and (faults := s.check(self.read(s.name))):
                raise RuntimeError(f"{s.name}: {'; '.join(faults)}")
        return out
