"""Run options and what follows from them on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from clausewise.functions.lexicon import SOFTWARE_NOUNS

PRESETS: dict[str, tuple[str, ...]] = {"software": SOFTWARE_NOUNS}
SEVERITIES = ("off", "info", "warning", "error")
MODES = ("flavored", "strict")
#: Findings of these rules keep their severity in strict mode.
ADVICE_PREFIX = "STE-GR-"


@dataclass(frozen=True)
class Options:
    mode: str = "flavored"
    min_confidence: float = 0.0
    max_words: int = 0
    max_noun_words: int = 0
    warnings_as_errors: bool = False
    allow_nouns: tuple[str, ...] = ()
    allow_verbs: tuple[str, ...] = ()
    presets: tuple[str, ...] = ()
    #: (preferred name, names to replace)
    prefer: tuple[tuple[str, tuple[str, ...]], ...] = ()
    disable: tuple[str, ...] = ()
    severities: Mapping[str, str] = field(default_factory=dict)
    keyword: str = "ste"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        for name in self.presets:
            if name not in PRESETS:
                raise ValueError(f"unknown preset {name!r}")
        for value in self.severities.values():
            if value not in SEVERITIES:
                raise ValueError(f"unknown severity {value!r}")

    @property
    def confidence(self) -> float:
        """Findings below this are dropped; 0 stands for the mode's own threshold."""
        return self.min_confidence or (0.0 if self.mode == "strict" else 0.6)

    @property
    def preset_nouns(self) -> tuple[str, ...]:
        return tuple(n for p in self.presets for n in PRESETS[p])

    @property
    def allowed(self) -> frozenset[str]:
        return frozenset(w.lower() for w in (*self.allow_nouns, *self.allow_verbs, *self.preset_nouns))

    def severity(self, rule_id: str, given: str) -> str:
        """A configured severity wins; strict mode raises; then warnings may become errors."""
        out = self.severities.get(rule_id)
        if out is None:
            out = given
            if self.mode == "strict" and not rule_id.startswith(ADVICE_PREFIX):
                out = "warning" if given == "info" else "error"
        return "error" if self.warnings_as_errors and out == "warning" else out
