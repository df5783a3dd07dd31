"""Decisions over states: is a comparison possible, did execution fail, which gaps concern an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comparison_state(base: Column, head: Column, is_ancestor: Column) -> Column:
    """Whether a baseline commit can be compared with the current one.

    Without a base it is comparable only if there is no head either; without a head, or with a base that is no
    ancestor, it has diverged. Equal commits need no ancestry.
    """
    no_base = F.when(head.isNull(), "Comparable").otherwise("BaselineCommitUnavailable")
    return F.when(base.isNull(), no_base).when(head.isNull(), "BaselineDiverged").when((base == head) | is_ancestor, "Comparable").otherwise("BaselineDiverged")


def execution_failed(build: Column, tests: Column, outcomes: Column, providers: list[tuple[Column, Column]], changes_complete: Column, timeouts: bool = True) -> Column:
    """Whether a verification could not be carried out.

    Build or tests were unavailable or timed out, tests failed without any outcome, an enabled provider (enabled,
    state) did not succeed, or the change set is incomplete. timeouts=False is the review's variant, for which a
    timeout is no failure and the change set is judged elsewhere.
    """
    broken = ["Unavailable", "TimedOut"] if timeouts else ["Unavailable"]
    out = build.isin(broken) | tests.isin(broken) | ((tests == "Failed") & (outcomes == 0))
    for enabled, state in providers:
        out = out | (enabled & state.isin(["Failed", *broken]))
    return out | ~changes_complete if timeouts else out


def gaps_in_scope(gap_project: Column, scope: Column) -> Column:
    """Whether a gap concerns an answer: one of the whole repository (no project), or of a project in the scope array."""
    return gap_project.isNull() | F.exists(scope, lambda p: F.lower(p) == F.lower(gap_project))
