"""A DAG of stages over a store: resumable, with parameter and content hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..sources.store import Store


@dataclass
class Stage:
    """run gets the store and the parameters and returns the outputs by name."""

    name: str
    run: Callable[[Store, dict], dict[str, DataFrame]]
    outputs: Sequence[str]
    params: Sequence[str] = field(default_factory=tuple)


def run_stages(
    store: Store, stages: Sequence[Stage], params: dict, start: str | None = None, stop: str | None = None, force: bool = False
) -> list[str]:
    """Run the stages in order, from `start` to `stop`; names of those that ran.

    A stage is passed over if it is done under equal parameters and none before it ran. When one runs,
    all after it are marked undone first, and its stale outputs are dropped. Unknown parameters raise.
    """
    known = {p for s in stages for p in s.params}
    if unknown := set(params) - known:
        raise KeyError(f"unknown parameters: {sorted(unknown)}")
    names = [s.name for s in stages]
    first, last = names.index(start) if start else 0, names.index(stop) if stop else len(stages) - 1
    ran: list[str] = []
    for n, stage in enumerate(stages):
        own = {p: params[p] for p in stage.params if p in params}
        if n < first or n > last or (not force and not ran and store.done(stage.name, own)):
            continue
        if not ran:
            for later in stages[n:]:
                store.mark(later.name, False, {})
        for o in stage.outputs:
            store.drop(o)
        for name, df in stage.run(store, own).items():
            if name not in stage.outputs:
                raise ValueError(f"{stage.name} returned {name}, which it does not declare")
            store.save(name, df)
        store.mark(stage.name, True, own, stage.outputs)
        ran.append(stage.name)
    return ran
