"""Settings of the phrase and thesaurus pipeline."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace

from .functions.text import PROCESSORS


@dataclass(frozen=True)
class Settings:
    processor: str = "moderate"
    min_count: int = 100
    max_ngram_order: int = 5
    max_phrase_length: int = 7
    npmi_thresholds: tuple[float, ...] = (0.3, 0.5, 0.5, 0.5)
    embeddings_case_sensitive: bool = False
    semantic_minimum: float = 0.3
    ortho_maximum: float = 0.4
    abbr_maximum: float = 0.5
    semantic_ortho_ratio: float = 1.0
    overall_threshold: float | None = None
    permutation_penalty: float | None = 1.0
    language: str = "ENG"
    ngram_count_filenames: tuple[str, ...] = ("1grams.txt", "2grams.txt", "3grams.txt", "4grams.txt", "5grams.txt")
    metathesaurus_home: str = ""
    lexicon_home: str = ""

    def threshold(self, order: int) -> float:
        """NPMI threshold of an order from 2; the last one holds for all beyond."""
        return self.npmi_thresholds[min(order - 2, len(self.npmi_thresholds) - 1)]


#: Keys of settings files in the other spelling, where it isn't the same name with capitals.
OTHER_KEYS = {"textProcessor": "processor", "semanticOrthoWeightRatio": "semantic_ortho_ratio"}
#: Options that a file switches off by not naming them.
_OPTIONS = ("overall_threshold", "permutation_penalty")


def _processor(name: str) -> str:
    """A registered processor of a name or a class name; an unknown one falls back to the moderate processor."""
    short = name.rpartition(".")[2].removesuffix("Processor").lower()
    short = {"null": "none"}.get(short, short)
    if short not in PROCESSORS:
        warnings.warn(f"unknown text processor {name!r}; the moderate one is used", stacklevel=3)
        return "moderate"
    return short


def load(path: str) -> Settings:
    """Settings from a file of ``key=value`` lines.

    Keys may be written like the fields or with inner capitals
    (``minCount``).  Unknown keys are ignored; missing ones keep their default,
    but an optional threshold or penalty that is empty, or not named in a file
    with inner capitals, is off.
    """
    found: dict = {}
    kinds = {f.name: f.type for f in fields(Settings)}
    capitals = False
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.partition("=")
            key, value = key.strip(), value.strip()
            if not eq or key.startswith("#"):
                continue
            name = OTHER_KEYS.get(key) or re.sub(r"[A-Z]", lambda m: "_" + m.group().lower(), key)
            if name not in kinds:
                continue
            capitals |= name != key
            kind = kinds[name]
            if name == "processor":
                found[name] = _processor(value)
            elif kind.startswith("tuple[str"):
                found[name] = tuple(x.strip() for x in value.split(","))
            elif kind.startswith("tuple"):
                found[name] = tuple(float(x) for x in value.split(","))
            elif kind == "bool":
                found[name] = value.lower() == "true"
            elif kind == "int":
                found[name] = int(value)
            elif kind == "str":
                found[name] = value
            else:
                found[name] = float(value) if value else None
    if capitals:
        found = {k: None for k in _OPTIONS} | found
    return replace(Settings(), **found)
