"""Three-valued logic over nullable booleans, as SQL expression text.

SQL's AND / OR / NOT already follow the Kleene truth table, so a predicate
stays UNKNOWN (NULL) exactly when its inputs leave it open. What SQL lacks is
counting under uncertainty and an ordered choice that stops at the first
UNKNOWN branch.

Expressions are text because one parsed expression costs the driver one call,
however large it is; the same tree built operator by operator costs one call
per operator.
"""

from __future__ import annotations

from collections.abc import Sequence

UNKNOWN = "UNKNOWN"


def all_of(*predicates: str) -> str:
    return "(" + " AND ".join(f"({p})" for p in predicates) + ")"


def any_of(*predicates: str) -> str:
    return "(" + " OR ".join(f"({p})" for p in predicates) + ")"


def negate(predicate: str) -> str:
    return f"(NOT ({predicate}))"


def _decide(trues: str, unknowns: str, k: int) -> str:
    return f"(CASE WHEN {trues} >= {k} THEN true WHEN {trues} + {unknowns} < {k} THEN false END)"


def at_least_k(predicates: Sequence[str], k: int) -> str:
    """True once k are true, False once k is out of reach, else UNKNOWN."""
    if k < 0:
        raise ValueError("k must be non-negative")
    trues = "(" + " + ".join(f"int(coalesce({p}, false))" for p in predicates) + ")"
    unknowns = "(" + " + ".join(f"int(({p}) IS NULL)" for p in predicates) + ")"
    return _decide(trues, unknowns, k)


def exactly_one(predicates: Sequence[str]) -> str:
    return all_of(negate(at_least_k(predicates, 2)), at_least_k(predicates, 1))


def count_if_all_known(predicates: Sequence[str]) -> str:
    """Number of true predicates, NULL if any is UNKNOWN."""
    return "(" + " + ".join(f"int({p})" for p in predicates) + ")"


def choose(branches: Sequence[tuple[str, str]], default: str) -> str:
    """First true branch; a branch that is UNKNOWN before that ends the search."""
    text = "CASE"
    for answer, predicate in branches:
        text += f" WHEN ({predicate}) THEN '{answer}' WHEN ({predicate}) IS NULL THEN '{UNKNOWN}'"
    return f"({text} ELSE '{default}' END)"


def at_least_k_in_window(predicate: str, over: str, width: int, k: int) -> str:
    """k of the last ``width`` rows; rows before the series starts are UNKNOWN.

    ``over`` is the partition and order clause, e.g. ``PARTITION BY u ORDER BY d``.
    """
    frame = f"OVER ({over} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    trues = f"count_if({predicate}) {frame}"
    falses = f"count_if(NOT ({predicate})) {frame}"
    return _decide(trues, f"({width} - {trues} - {falses})", k)


def stressed(pressure: str, shock: str, down_tail: str, persistence: str) -> str:
    """Elevated pressure confirmed by at least one of three axes."""
    confirmed = any_of(f"{shock} >= 65", f"{down_tail} >= 70", f"{persistence} >= 65")
    return all_of(f"{pressure} >= 65", confirmed)
