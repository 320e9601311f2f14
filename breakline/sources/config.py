"""Configuration: defaults, and overrides from a properties file."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SoftClip:
    min_average_qual: float = 5.0
    min_length: int = 5
    min_anchor_identity: float = 0.95


@dataclass(frozen=True)
class Assembly:
    k: int = 25
    min_reads: int = 3
    anchor_length: int = 300
    max_expected_breakend_length_multiple: float = 1.5
    error_correction_k: int = 21
    error_correction_multiple: int = 10


@dataclass(frozen=True)
class Calling:
    min_reads: int = 2
    min_score: float = 50.0
    min_size: int = 10
    breakend_margin: int = 10
    breakpoint_low_quality: float = 500.0
    breakend_low_quality: float = 1500.0
    breakend_max_assembly_bias: float = 0.5
    ignore_missing_deletions: int = 500


@dataclass(frozen=True)
class Config:
    min_mapq: int = 20
    fallback_mapq: int = 20
    max_coverage: int = 25_000
    min_anchor_entropy: float = 0.5
    dovetail_margin: int = 4
    chunk_size: int = 10_000_000
    chunk_change_penalty: int = 250_000
    adapters: tuple[str, ...] = ("AGATCGGAAGAG", "ATGGAATTCTCG", "CTGTCTCTTATA")
    scoring_model: str = "FastEmpiricalReferenceLikelihood"
    soft_clip: SoftClip = field(default_factory=SoftClip)
    assembly: Assembly = field(default_factory=Assembly)
    calling: Calling = field(default_factory=Calling)

    @classmethod
    def from_properties(cls, text: str) -> Config:
        """Lines ``name = value``; sections by prefix (``calling.min_score``). Unknown names are refused."""
        return _override(cls(), dict(_pairs(text)))


def _pairs(text: str):
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            name, _, value = line.partition("=")
            yield name.strip(), value.strip()


def _override(obj, pairs: dict[str, str]):
    names = {f.name for f in dataclasses.fields(obj)}
    changes: dict = {}
    inner: dict[str, dict[str, str]] = {}
    for key, value in pairs.items():
        head, _, rest = key.partition(".")
        if head not in names:
            raise KeyError(key)
        old = getattr(obj, head)
        if rest:
            inner.setdefault(head, {})[rest] = value
        elif isinstance(old, tuple):
            changes[head] = tuple(x.strip() for x in value.split(",") if x.strip())
        else:
            changes[head] = type(old)(value)
    for head, sub in inner.items():
        changes[head] = _override(getattr(obj, head), sub)
    return dataclasses.replace(obj, **changes)
