"""Named stages composed into one lazy Spark plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

Stage = Callable[[dict[str, DataFrame]], DataFrame]


class Stages:
    """A graph of named stages; a stage receives the frames of the stages it depends on.

    >>> flow = Stages()
    >>> flow.source("docs", docs)
    >>> flow.stage("chunks", ["docs"], lambda inputs: chunk(inputs["docs"]))
    >>> flow.result("chunks")
    """

    def __init__(self) -> None:
        self._stages: dict[str, tuple[list[str], Stage]] = {}
        self._done: dict[str, DataFrame] = {}

    def source(self, name: str, frame: DataFrame) -> None:
        self._check_new(name)
        self._stages[name] = ([], lambda _: frame)

    def stage(self, name: str, deps: Sequence[str], fn: Stage) -> None:
        self._check_new(name)
        if not deps:
            raise ValueError(f"stage {name!r} has no dependency to receive from")
        missing = [d for d in deps if d not in self._stages]
        if missing:
            raise ValueError(f"stage {name!r} depends on unknown stages {missing}")
        self._stages[name] = (list(deps), fn)

    def result(self, name: str) -> DataFrame:
        """The frame of a stage; shared inputs are built once."""
        if name not in self._done:
            deps, fn = self._stages[name]
            self._done[name] = fn({d: self.result(d) for d in deps})
        return self._done[name]

    def _check_new(self, name: str) -> None:
        if name in self._stages:
            raise ValueError(f"stage {name!r} is already defined")
