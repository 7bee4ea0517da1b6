"""Cutting texts into units that a byte-level BPE treats one by one, so that each distinct unit is worked on once.

The pattern of the vocabularies lets a pre-token begin at a space that a visible character follows, whatever stands
before. A text may therefore be cut before every such space, and what one unit gives never depends on the others.
"""

from __future__ import annotations

import re

_IRREGULAR = re.compile(r" \s| \Z")


def units(text: str) -> tuple[str, list[str]]:
    """The text up to the first such space, and the units behind it, each without the space it begins with."""
    parts = text.split(" ")
    if len(parts) == 1 or not _IRREGULAR.search(text):
        return parts[0], parts[1:]
    groups = [[parts[0]]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            groups.append([part])
        else:
            groups[-1].append(part)
    first, *rest = (" ".join(group) for group in groups)
    return first, rest
