"""The slot grid of a table with merged cells."""

from __future__ import annotations

import re


def span(value: str | None) -> int:
    """A colspan or rowspan: digits only, from 1 to 1000; anything else is 1."""
    return min(max(int(value), 1), 1000) if value and re.fullmatch("[0-9]+", value) else 1


def table_grid(groups: list[list[list[tuple[int, int]]]]) -> tuple[int, list[list[int | None]], list[str]]:
    """Column count, for every row the cell that starts in each slot (None: covered or empty), and what is wrong.

    groups are row groups of rows of (colspan, rowspan) cells. The first row's spans make the
    columns. A cell takes the leftmost free slot and is cut at the last column; a row span ends
    with its group.
    """
    width = sum(wide for wide, _ in next((g[0] for g in groups if g), []))
    grid: list[list[int | None]] = []
    wrong: list[str] = []
    for group in groups:
        until = [0] * width  # first row of the group in which a slot is free again
        for r, cells in enumerate(group):
            name = f"row {len(grid) + 1}"
            starts: list[int | None] = [None] * width
            free = [s for s in range(width) if until[s] <= r]
            taken = set(range(width)).difference(free)
            for k, (wide, high) in enumerate(cells):
                at = next((s for s in free if s not in taken), None)
                if at is None:
                    wrong.append(f"{name}: cell {k + 1} does not fit (the header defines {width} column(s))")
                    break
                starts[at] = k
                if high > len(group) - r:
                    wrong.append(f"{name}: rowspan {high} extends past its row group")
                if at + wide > width:
                    wrong.append(f"{name}: cell {k + 1} spans past column {width}")
                for s in range(at, min(at + wide, width)):
                    if s in taken:
                        wrong.append(f"{name}: cells overlap at column {s + 1}")
                    else:
                        taken.add(s)
                        until[s] = r + min(high, len(group) - r)
            if len(taken) < width:
                wrong.append(f"{name} covers {len(taken)} of {width} column(s)")
            grid.append(starts)
    return width, grid, wrong
