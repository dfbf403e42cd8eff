"""Page layout of extracted text: pages with wrapped lines and the line ends that wrapping made."""

from __future__ import annotations

LEAST_SHARE = 0.13  # of the lines that reach the page's width, give or take SLACK characters
SLACK = 4
OUTLIERS = 4  # per cent of the lines


def _first_unit(line: str) -> int:
    """Characters that wrapping keeps together at the start of a line: one wide character, or a run of others up to a blank."""
    n = 0
    for c in line:
        if c >= "⺀":
            return n or 1
        if c == " ":
            return n or 1
        n += 1
    return n


def wrapped(lines: list[str]) -> tuple[int, list[bool]]:
    """The page width in characters (0: the text isn't wrapped), and per line whether it ends because the page does."""
    sizes = list(map(len, lines))
    # a few lines may stick out: watermarks, addresses that can't be divided
    page = sorted(sizes, reverse=True)[max(1, len(sizes) * OUTLIERS // 100)] if len(sizes) > 1 else 0
    near = sum(page - SLACK <= n <= page for n in sizes)
    if page < 12 or near < 4 or near < LEAST_SHARE * len(lines):
        return 0, [False] * len(lines)
    last = len(lines) - 1
    return page, [
        i < last and lines[i + 1] != "" and (n >= page - SLACK or n > page // 3 and n + _first_unit(lines[i + 1]) > page) for i, n in enumerate(sizes)
    ]
