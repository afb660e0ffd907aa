"""Fewest chunks that cover a case's evidence: exact within a bounded number of steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 100_000


class OutOfSteps(Exception):
    pass


def cover(options: dict[str, set], atoms: set, max_steps: int = MAX_STEPS) -> tuple[str, int | None, int | None, int | None, list[str]]:
    """(status, minimum, lower bound, upper bound, witness names) of covering ``atoms`` by named sets.

    ``impossible`` if no choice covers them (or there is nothing to cover),
    ``exact`` with the minimum, or ``unknown`` with bounds when the search takes
    more than ``max_steps`` steps. The search asks for covers of one, two, three,
    ... names in turn. It always settles the atom that the fewest names hold: one
    of those names must be in the cover, so no other choice is ever tried there.
    Among names that hold the same atoms the smallest stands for all.
    """
    holders: dict = {atom: [] for atom in atoms}
    first = {frozenset(held & atoms): name for name, held in sorted(options.items(), reverse=True)}
    reach = {name: held for held, name in sorted(first.items(), key=lambda x: x[1]) if held}
    for name, held in reach.items():
        for atom in held:
            holders[atom].append(name)
    if not atoms or not all(holders.values()):
        return "impossible", None, None, None, []
    widest = max(map(len, reach.values()))
    upper = _any_cover(holders, reach)
    left = max_steps

    def settle(open_atoms: frozenset, names: int) -> list[str] | None:
        """Names of a cover of the open atoms by ``names`` sets at most."""
        nonlocal left
        if not open_atoms:
            return []
        if len(open_atoms) > names * widest:
            return None
        rarest = min(open_atoms, key=lambda a: (len(holders[a]), a))
        for name in sorted(holders[rarest], key=lambda n: (-len(reach[n] & open_atoms), n)):
            left -= 1
            if left < 0:
                raise OutOfSteps
            if (rest := settle(open_atoms - reach[name], names - 1)) is not None:
                return [name, *rest]
        return None

    lower = -(-len(atoms) // widest)
    try:
        while lower < len(upper):
            if (found := settle(frozenset(atoms), lower)) is not None:
                upper = found
                break
            lower += 1
    except OutOfSteps:
        return "unknown", None, lower, len(upper), upper
    return "exact", len(upper), len(upper), len(upper), upper


def _any_cover(holders: dict, reach: dict[str, frozenset]) -> list[str]:
    """A cover that need not be smallest: the widest holder of each atom that is still open, rarest atoms first."""
    names, held = [], set()
    for atom in sorted(holders, key=lambda a: (len(holders[a]), a)):
        if atom not in held:
            names.append(max(holders[atom], key=lambda n: len(reach[n] - held)))
            held |= reach[names[-1]]
    return names


def minimum_covers(atom_options: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """``(case_id, status, minimum, lower_bound, upper_bound, witness)`` per case.

    ``atom_options``: one row ``(case_id, atom, id)`` per atom and covering chunk,
    id null for an atom that nothing covers. One case's evidence is small (the
    spans of one question), so a case is one group.
    """
    schema = "case_id string, status string, minimum int, lower_bound int, upper_bound int, witness array<string>"

    def run(table: pa.Table) -> pa.Table:
        options: dict[str, set] = {}
        for atom, name in zip(table["atom"].to_pylist(), table["id"].to_pylist()):
            if name is not None:
                options.setdefault(name, set()).add(atom)
        status, *numbers, witness = cover(options, set(table["atom"].to_pylist()), max_steps)
        row = [[table["case_id"][0].as_py()], [status], *([n] for n in numbers), [sorted(witness)]]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        return pa.table([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return atom_options.select(F.col("case_id").cast("string"), F.col("atom").cast("string"), F.col("id").cast("string")).groupBy("case_id").applyInArrow(run, schema)
