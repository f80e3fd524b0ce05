"""Rule data, and the small builders that rules are written with."""

from __future__ import annotations

from dataclasses import dataclass, field


# A rule may have ``words``: then none of its patterns matches a full stop, and each match holds one of these words, in any
# case (a word may stand between ``\b``), so that other stretches of a text need not be searched.
@dataclass(frozen=True)
class Finding:
    name: str
    severity_label: str
    presence: list[str]
    correctness: list[str]
    attenuation: list[str]
    severity_optional: bool = False
    notes: str = ""
    words: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Term:
    canonical: str
    entity_type: str
    patterns: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def near(concept: str, marker: str, window: int = 80) -> str:
    """A pattern for ``concept`` and ``marker``, in either order, at most ``window`` characters of one sentence apart."""
    gap = f"[^.]{{0,{window}}}"
    return f"(?:{concept}{gap}{marker}|{marker}{gap}{concept})"
