"""Rules that make files from files, run in order where outputs are missing or old.

A rule names its inputs and outputs (paths of tables in any store that Spark
reads) and a function that writes the outputs.  What it does is a Spark job;
the driver only orders rules and compares times of change.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

Make = Callable[[SparkSession, list[str], list[str]], None]


@dataclass(frozen=True)
class Rule:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    make: Make


def expand(pattern: str, **values: Iterable) -> list[str]:
    """``pattern`` filled in with every combination of the values, the last name changing fastest."""
    return [pattern.format(**dict(zip(values, combo))) for combo in itertools.product(*values.values())]


def changed(spark: SparkSession, path: str) -> int | None:
    """When a file or a table was finished, in milliseconds; nothing if it was not."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    status = files.getFileStatus(place)
    if not status.isDirectory():
        return status.getModificationTime()
    done = jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
    if files.exists(done):
        return files.getFileStatus(done).getModificationTime()
    held = [s.getModificationTime() for s in files.listStatus(place)]
    return max(held) if held else None  # an unfinished table counts as missing


def in_order(rules: Iterable[Rule], targets: Iterable[str] | None = None) -> list[Rule]:
    """The rules that ``targets`` (all outputs by default) need, each after those it reads from.

    ``ValueError`` for an output of two rules, a target of none, or a cycle.
    """
    maker: dict[str, Rule] = {}
    for rule in rules:
        for path in rule.outputs:
            if path in maker:
                raise ValueError(f"{path} is an output of {maker[path].name} and of {rule.name}")
            maker[path] = rule
    placed: list[Rule] = []
    state: dict[str, bool] = {}  # False while a rule's inputs are being placed

    def place(rule: Rule) -> None:
        if state.get(rule.name):
            return
        if rule.name in state:
            raise ValueError(f"{rule.name} needs its own output")
        state[rule.name] = False
        for path in rule.inputs:
            if path in maker:
                place(maker[path])
        state[rule.name] = True
        placed.append(rule)

    for path in maker if targets is None else targets:
        if path not in maker:
            raise ValueError(f"no rule makes {path}")
        place(maker[path])
    return placed


def run(spark: SparkSession, rules: Iterable[Rule], targets: Iterable[str] | None = None) -> list[str]:
    """Runs what is missing or older than an input, or follows a rule that ran; the names in order.

    ``ValueError`` if an input is missing that no rule makes, before anything runs.
    """
    ordered = in_order(rules, targets)
    made = {path for rule in ordered for path in rule.outputs}
    lost = [path for rule in ordered for path in rule.inputs if path not in made and changed(spark, path) is None]
    if lost:
        raise ValueError(f"missing inputs: {sorted(set(lost))}")
    ran, fresh = [], set()
    for rule in ordered:
        outputs = [changed(spark, path) for path in rule.outputs]
        inputs = [changed(spark, path) for path in rule.inputs]
        stale = None in outputs or bool(fresh & set(rule.inputs)) or (bool(inputs) and max(inputs) > min(outputs))
        if stale:
            rule.make(spark, list(rule.inputs), list(rule.outputs))
            still = [path for path in rule.outputs if changed(spark, path) is None]
            if still:
                raise ValueError(f"{rule.name} did not make {still}")
            fresh |= set(rule.outputs)
            ran.append(rule.name)
    return ran
