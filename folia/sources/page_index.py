"""An index over one page's pre-order rows, shared by the operators that fold a whole page."""

from __future__ import annotations

import re

#: Blanks as browsers see them.
BLANK = "\t\n\v\f\r \xa0                　﻿"
BLANKS = re.compile(f"[{BLANK}]+")
_LONG_BLANKS = re.compile(f"[{BLANK}]{{2,}}")


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


class PageIndex:
    """Columns of the rows of `folia.sources.html.tree`; a subtree is the range k .. last[k]."""

    def __init__(self, rows: list[list]):
        self.last = [r[1] for r in rows]
        self.parent = [r[2] for r in rows]
        self.tag = [r[5].split(":", 1)[-1].lower() if r[4] == "element" else None for r in rows]
        self.attrs = [r[6] or {} for r in rows]
        self.text = [r[7] for r in rows]
        self.kids: list[list[int]] = [[] for _ in rows]
        for k, p in enumerate(self.parent):
            if p >= 0:
                self.kids[p].append(k)
        self.body = next((k for k, t in enumerate(self.tag) if t == "body"), None)

    def elements_in(self, k: int) -> list[int]:
        return [c for c in self.kids[k] if self.tag[c]]

    def below(self, k: int, tags) -> list[int]:
        return [i for i in range(k + 1, self.last[k] + 1) if self.tag[i] in tags]

    def above(self, k: int):
        while (k := self.parent[k]) >= 0:
            yield k


def squeezed(text: str) -> str:
    """Trimmed, with runs of two or more blanks as one space."""
    return _LONG_BLANKS.sub(" ", text.strip(BLANK))
