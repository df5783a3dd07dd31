"""Evidence bundles: wrapped excerpts, a reserved place for lexical finds, and shrinking to a token budget.

These work on the blocks already chosen, a page of results (MaxResults rows at most), as plain rows on the driver;
candidates are ranked and cut by the DataFrame operators before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_GAPS, MOST_EDGES, MOST_ITEMS = 12, 40, 20


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def wrapped_excerpt(text: Column, best: Column) -> Column:
    """The lines from four above to five below the best line (from 1)."""
    lines = F.split(text, r"\r?\n")
    first = F.greatest(F.lit(1), best - 4)
    return F.array_join(F.slice(lines, first.cast("int"), F.greatest(F.lit(0), F.least(F.size(lines), best + 5) - first + 1).cast("int")), "\n")


def reserve_lexical(blocks: list[dict], lexical: dict | None, most: int, filtered: bool = False) -> list[dict]:
    """Blocks with one place for the lexical find.

    Without filters and with more than one place, the last block in order whose file has an earlier block gives its
    place up to a lexical find of high confidence; an open place takes any find whose file is not there yet.
    """
    if lexical is None or filtered or most <= 1 or any(b["file"] == lexical["file"] for b in blocks):
        return blocks[:most]
    if len(blocks) < most:
        return [*blocks, lexical]
    spare = [i for i, b in enumerate(blocks[:most]) if any(b["file"] == x["file"] for x in blocks[:i])]
    if not spare or lexical.get("confidence") != "high":
        return blocks[:most]
    return [*blocks[: spare[-1]], *blocks[spare[-1] + 1 : most], lexical]


def shrink_bundle(blocks: list[dict], gaps: list[str], budget: int, render: Callable[[list[dict], list[str]], str], notice: str = "Evidence was cut to the token budget.") -> tuple[list[dict], list[str], bool]:
    """Blocks, gaps and whether anything was cut, so that the rendered bundle fits the budget as far as possible.

    The last blocks go first, down to one; its text is cut, then it goes too; only then gaps go, and one stays beside the notice.
    """
    blocks, gaps = [dict(b) for b in blocks], list(gaps[:MOST_GAPS])
    if estimate(render(blocks, gaps)) <= budget:
        return blocks, gaps, False
    over = lambda: estimate(render(blocks, [*gaps, notice])) - budget
    while len(blocks) > 1 and over() > 0:
        blocks.pop()
    if blocks and (excess := over()) > 0:
        blocks[-1]["text"] = blocks[-1]["text"][: max(0, len(blocks[-1]["text"]) - 4 * excess)]
        if not blocks[-1]["text"] or over() > 0:
            blocks.pop()
    while len(gaps) > 1 and over() > 0:
        gaps.pop()
    return blocks, [*gaps, notice], True


def shrink_references(matches: list, ambiguous: list, gaps: list, budget: int, render: Callable[[list, list, list], str]) -> tuple[list, list, list, bool]:
    """Matches, then ambiguous names, then gaps are dropped from their ends until the rendered answer fits."""
    lists = [list(matches), list(ambiguous), list(gaps)]
    cut = False
    for rows in lists:
        while rows and estimate(render(*lists)) > budget:
            rows.pop()
            cut = True
    return *lists, cut


def capped_list(title: str, items: list[str], most: int = MOST_ITEMS) -> str:
    """A titled list for people, with how many more there are."""
    more = [f"  … and {len(items) - most} more"] if len(items) > most else []
    return "\n".join([title, *(f"  {x}" for x in items[:most]), *more])
