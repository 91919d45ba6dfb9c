"""Parsing configuration: presets, YAML files, and the lookup by document type."""

from __future__ import annotations

import copy
import hashlib
import json
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass

#: List markers, as literals and as regular expressions.
BULLETS = ("•", "·", "●", "■", "▪", "▫", "◦", "‣", "⁃", "-", "*", "→", "➤", "✓", "&bull;", "&middot;")
NUMBERED = (r"^\d+\.", r"^\d+\)", r"^\(\d+\)", r"^[a-z]\.", r"^[a-z]\)", r"^[A-Z]\.", r"^[A-Z]\)", r"^[ivx]+\.", r"^[IVX]+\.")
MATH_SYMBOLS = ("→", "←", "⇒", "⇐", "∀", "∃")
MATH_TERMS = ("equation", "formula", "coordinates", "system", "transform")


@dataclass
class Rule:
    name: str
    enabled: bool = True


@dataclass
class Headings:
    min_header_size: float = 8.5
    use_bold_indicator: bool = True
    bold_size_strict: bool = True
    max_depth: int = 5
    enforce_max_depth: bool = True
    font_size_tolerance: float = 0.1
    starting_section_level: int = 1
    section_patterns: tuple[str, ...] = ()


@dataclass
class Clustering:
    enable_paragraph_merging: bool = True
    enable_spatial_adjacency: bool = False
    min_line_height: float = 8.0
    line_height_multiplier: float = 0.8
    horizontal_tolerance: float = 10.0
    max_section_size: int = 300
    max_paragraph_size: int = 8000


@dataclass
class Lists:
    sequence_lookahead_elements: int = 10
    sequence_boundary_extension: int = 3
    y_tolerance: float = 15.0
    last_item_boundary_gap: float = 80.0
    bullets: tuple[str, ...] = BULLETS
    numbered: tuple[str, ...] = NUMBERED
    create_list_containers: bool = True
    preserve_list_items: bool = False
    minimum_size_check: bool = True
    first_item_validation: bool = True
    parenthetical_context_check: bool = True
    sequential_numbering_check: bool = True
    mathematical_context_check: bool = True
    hyphen_context_check: bool = True
    allow_letter_sequences: bool = True
    max_gap_tolerance: int = 0
    hyphen_strategy: str = "strict"
    require_space_after: bool = True
    math_symbols: tuple[str, ...] = MATH_SYMBOLS
    math_terms: tuple[str, ...] = MATH_TERMS


@dataclass
class Sizing:
    max_size: int = 800
    size_unit: str = "characters"
    min_size_ratio: float = 0.3
    preserve_sentences: bool = True
    max_iterations: int = 10


@dataclass
class Config:
    """One parsing configuration; rules run in the order given."""

    rules: list[Rule] = field(default_factory=lambda: [Rule("SpatialClustering+StyleAnalysis"), Rule("Validation")])
    headings: Headings = field(default_factory=Headings)
    clustering: Clustering = field(default_factory=Clustering)
    lists: Lists = field(default_factory=Lists)
    sizing: Sizing = field(default_factory=Sizing)
    pattern_regexes: tuple[str, ...] = ()
    respect_constraints: bool = True
    minimal_parse: bool = False

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def preset(name: str) -> Config:
    """``library``, ``cli``, ``academic`` or ``legal``; other names give ``library``."""
    c = Config()
    if name == "cli":
        c.rules = [Rule("SectionDetection"), Rule("SpatialClustering")]
        c.headings = Headings(9.5, True, False, 6, True, 0.1, 1)
        c.clustering = Clustering(True, True, 8.0, 10.0, 15.0, 300, 3000)
        c.lists.y_tolerance = 10.0
        c.sizing.max_size = 400
    elif name == "academic":
        c.headings = Headings(10.0, True, True, 4, True, 0.1, 1, ("abstract", "introduction", "methodology", "results", "discussion", "conclusion", "references"))
        c.clustering = Clustering(True, False, 9.0, 1.2, 8.0, 500, 12000)
    elif name == "legal":
        c.headings = Headings(9.0, True, True, 5, True, 0.1, 1, ("article", "section", "clause", "whereas", "terms", "conditions"))
        c.clustering = Clustering(True, False, 8.5, 0.6, 12.0, 200, 5000)
    return c


def for_document_type(document_type: str | None) -> Config:
    """The configuration of a document type; unknown types take the generic one, with its section words."""
    if document_type in ("Academic", "Legal"):
        return preset(document_type.lower())
    c = preset("library")
    c.headings.section_patterns = ("chapter", "section", "part", "overview", "summary", "background", "principles", "approach")
    return c


def _fill(target: object, values: dict) -> None:
    known = {f.name for f in fields(target)}
    for k, v in (values or {}).items():
        if k not in known or v is None:
            continue
        now = getattr(target, k)
        if is_dataclass(now):
            _fill(now, v)
        elif k == "rules":
            target.rules = [Rule(r["name"], r.get("enabled", True)) if isinstance(r, dict) else Rule(str(r)) for r in v]
        else:
            setattr(target, k, tuple(v) if isinstance(now, tuple) else type(now)(v))


def load(path: str, fallback: bool = True) -> Config:
    """A YAML file with the fields above; with ``fallback`` an unreadable file warns and gives the library preset."""
    import yaml

    c = preset("library")
    try:
        with open(path) as f:
            _fill(c, yaml.safe_load(f) or {})
    except (OSError, yaml.YAMLError, TypeError, ValueError) as e:
        if not fallback:
            raise
        warnings.warn(f"{path}: {e}; the library preset is used", stacklevel=2)
        return preset("library")
    return copy.deepcopy(c)
