"""Processing levels: which stages are composed into a plan. Presets don't change; an override makes a copy."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Preset:
    level: str
    match_templates: bool = True
    apply_templates: bool = True
    threshold: float = 0.7
    annotate: bool = True
    vectorize: bool = False
    outputs: tuple[str, ...] = ("docjson", "annotations")


PRESETS = {
    "basic": Preset("basic", False, False, 0.7, False, False, ("docjson",)),
    "standard": Preset("standard"),
    "complete": Preset("complete", True, True, 0.6, True, True, ("docjson", "annotations", "vectors")),
}
#: Names of older modes.
MODES = {"fast": "basic", "enhanced": "standard", "vectorize": "complete", "complete": "complete"}
RECOMMENDED = {("technical_standard", "analysis"): "complete", ("technical_standard", "archive"): "standard", ("report", "archive"): "basic"}


def preset(level: str, **override: object) -> Preset:
    """The preset of a level or older mode, with overrides (UD-6, PRJ-23)."""
    name = MODES.get(level, level)
    if name not in PRESETS:
        raise ValueError(f"unknown level {level}")
    known = {f.name for f in fields(Preset)} - {"level"}
    if set(override) - known:
        raise ValueError(f"unknown settings {sorted(set(override) - known)}")
    return replace(PRESETS[name], **override)


def recommended(document: str, use: str) -> str:
    """PRJ-24."""
    return RECOMMENDED.get((document, use), "standard")


def warnings(p: Preset) -> list[str]:
    """PRJ-25."""
    out = [] if 0 <= p.threshold <= 1 else ["threshold is not between 0 and 1"]
    if p.apply_templates and not p.match_templates:
        out.append("templates are applied but not matched")
    if "vectors" in p.outputs and not p.vectorize:
        out.append("vectors are written but not made")
    if "annotations" in p.outputs and not p.annotate:
        out.append("annotations are written but not made")
    return out
