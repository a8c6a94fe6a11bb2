"""Analysis packs: named steps that need one another, run in order, their results put beside each other by media.

A pack that fails leaves its error and nothing else; what needs it is left out and says so. Results of all packs are
united and grouped by media once, so a context of any number of results costs one shuffle, not one for each join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pack:
    """A step: `run` gets the tables or results named in `needs` and gives one row for each media; its name is no table's. One with `always` runs
    whatever is wanted; one that isn't `shown` only serves others."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    always: bool = False
    shown: bool = True


def in_order(packs: Iterable[Pack], wanted: set[str] | None = None) -> list[Pack]:
    """The packs that are wanted (all without a list), always run, or are needed by these; each after what it needs.

    Of packs with one name the last counts. Packs that need each other are an error.
    """
    by_name = {p.name: p for p in packs}
    if unknown := (wanted or set()) - by_name.keys():
        raise KeyError(f"no such pack: {', '.join(sorted(unknown))}")
    out: dict[str, Pack] = {}
    open_names: list[str] = []

    def visit(name: str) -> None:
        if name in out or name not in by_name:
            return
        if name in open_names:
            raise ValueError("packs need each other: " + " > ".join([*open_names, name]))
        open_names.append(name)
        for need in by_name[name].needs:
            visit(need)
        open_names.pop()
        out[name] = by_name[name]

    for pack in by_name.values():
        if wanted is None or pack.always or pack.name in wanted:
            visit(pack.name)
    return list(out.values())


def assembled(results: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key that any result has, with the columns of all; null where a result lacks the key.

    Of several rows of a result with one key the greatest counts. A column that two results have is an error.
    """
    columns = {name: [c for c in df.columns if c not in keys] for name, df in results.items()}
    seen = [c for cs in columns.values() for c in cs]
    if twice := {c for c in seen if seen.count(c) > 1}:
        raise ValueError(f"columns of several results: {', '.join(sorted(twice))}")
    kinds = {name: df.select(F.struct(*columns[name]).alias("s")).schema["s"].dataType for name, df in results.items()}
    slot = {name: f"r{k}" for k, name in enumerate(results)}
    parts = [df.select(*keys, *((F.struct(*columns[n]) if n == name else F.lit(None).cast(kinds[n])).alias(slot[n]) for n in results)) for name, df in results.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    grouped = united.groupBy(*keys).agg(*(F.max(s).alias(s) for s in slot.values()))
    return grouped.select(*keys, *(F.col(slot[n]).getField(c).alias(c) for n in results for c in columns[n]))


def analyse(spark: SparkSession, inputs: dict[str, DataFrame], packs: Iterable[Pack], keys: list[str], wanted: set[str] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(context, problems): the results of the packs beside each other (None if none came through), and (pack, error).

    Errors of building a pack's plan are caught. `keep` stores a result, such as a table in the shared folder: then a pack
    runs as a job of its own, and its errors at work are caught as well.
    """
    known, problems, shown = dict(inputs), [], {}
    for pack in in_order(packs, wanted):
        if missing := [n for n in pack.needs if n not in known]:
            problems.append((pack.name, f"needs {', '.join(missing)}"))
            continue
        try:
            result = pack.run(*(known[n] for n in pack.needs))
            if absent := set(keys) - set(result.columns):
                raise ValueError(f"no column {', '.join(sorted(absent))}")
            known[pack.name] = keep(result) if keep else result
        except Exception as error:  # whatever a pack raises is its own; the others go on
            problems.append((pack.name, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
            continue
        if pack.shown:
            shown[pack.name] = known[pack.name]
    context = assembled(shown, keys) if shown else None
    return context, spark.createDataFrame(problems, "pack string, error string")
