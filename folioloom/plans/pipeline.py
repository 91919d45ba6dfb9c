"""The whole chain from elements to document graphs, one DataFrame a stage."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.config import Config, preset
from folioloom.operators import clustering, headings, lists, profile, sizing, tree, typography, validate
from folioloom.operators.elements import parsed as base
from folioloom.session import checkpointed


class Pipeline:
    """Stages over one corpus. Each stage that later ones read several times is written once (a reliable checkpoint).

    ``rules`` maps a rule's name to DataFrame -> DataFrame; unknown and disabled rules pass elements through, and more can
    be registered. The Validation rule passes elements through too; its report is ``issues`` and ``quality``.
    """

    def __init__(self, text_elements: DataFrame, font_classes: DataFrame, metadata: DataFrame | None = None, config: Config | None = None) -> None:
        self.text_elements, self.font_classes, self.metadata = text_elements, font_classes, metadata
        self.config = config or preset("cli")
        self.rules: dict[str, Callable[[DataFrame], DataFrame]] = {
            "SectionDetection": lambda df: headings.detect_sections(df, self.sizes, self.config.headings),
            "SpatialClustering": lambda df: clustering.cluster(df, self.config.clustering),
            "Validation": self._validate,
        }
        self._validated: DataFrame | None = None
        #: Planning time of each rule, in seconds.
        self.rule_timings: dict[str, float] = {}

    def opt_in(self) -> Pipeline:
        """Adds the rules that are off by default: patterns, lists and sizes."""
        h = self.config.headings
        self.rules["PatternBasedSectionDetection"] = lambda df: lists.patterns_to_sections(df, self.config.pattern_regexes, h.min_header_size, h.use_bold_indicator, self.config.respect_constraints)
        self.rules["ListDetection"] = lambda df: lists.detect_lists(df, self.config.lists)
        self.rules["SizeEnforcer"] = lambda df: sizing.enforce(df, self.config.sizing).drop("part")
        return self

    def _validate(self, df: DataFrame) -> DataFrame:
        self._validated = df
        return df

    @cached_property
    def parsed(self) -> DataFrame:
        return checkpointed(base(self.text_elements))

    @cached_property
    def analysis(self) -> DataFrame:
        return checkpointed(typography.document_analysis(self.text_elements))

    @cached_property
    def sizes(self) -> DataFrame:
        sizes = typography.font_size_analysis(self.text_elements, self.font_classes)
        return checkpointed(sizes.join(self.analysis.select("doc_id", "most_common_font_size"), "doc_id", "full"))

    @cached_property
    def ruled(self) -> DataFrame:
        """The elements after all rules."""
        df = self.parsed
        if self.config.minimal_parse:
            return df
        for rule in self.config.rules:
            step = self.rules.get(rule.name)
            if rule.enabled and step:
                began = time.time()
                df = checkpointed(step(df))
                self.rule_timings[rule.name] = time.time() - began
        return df

    @cached_property
    def _report_on(self) -> tuple[DataFrame, int, bool]:
        """What is validated: the elements that reach the Validation rule; where it is off, those after all rules."""
        ruled = self.ruled
        names = [r.name for r in self.config.rules if r.enabled] if not self.config.minimal_parse else []
        if self._validated is not None:
            names = names[: names.index("Validation")]
        merged = self.config.clustering.enable_paragraph_merging and "SpatialClustering" in names
        return ruled if self._validated is None else self._validated, self.config.headings.max_depth, merged

    @cached_property
    def issues(self) -> DataFrame:
        return validate.issues(*self._report_on)

    @cached_property
    def quality(self) -> DataFrame:
        return validate.quality(*self._report_on)

    @cached_property
    def titles(self) -> DataFrame:
        return tree.merge_titles(self.ruled, self.metadata) if self.metadata is not None else self.ruled.select("doc_id").distinct().join(tree.infer_titles(self.ruled), "doc_id", "left")

    @cached_property
    def nodes(self) -> DataFrame:
        return checkpointed(tree.build(self.ruled, self.titles))

    @cached_property
    def profile(self) -> DataFrame:
        return profile.profile(profile.flat_nodes(self.nodes))

    def stage_counts(self) -> DataFrame:
        """stage, n: text elements, parsed elements and graph nodes."""
        return (
            self.parsed.agg(F.count("*").alias("n")).select(F.lit("text_elements").alias("stage"), "n")
            .unionByName(self.ruled.agg(F.count("*").alias("n")).select(F.lit("parsed_elements").alias("stage"), "n"))
            .unionByName(self.nodes.agg(F.count("*").alias("n")).select(F.lit("graph_nodes").alias("stage"), "n"))
        )

    def dump(self, path: str) -> None:
        """Writes every stage below ``path``."""
        for name in ("parsed", "analysis", "ruled", "issues", "quality", "nodes", "profile"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
