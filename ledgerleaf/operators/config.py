"""Configuration of the audit: one frozen dataclass for each group of operators, and partial overrides of any of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators import chunking, embed, issues, patterns

T = TypeVar("T")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters, except ``target`` and ``image_tokens``, which are tokens; ``method`` is natural, adaptive or pages."""

    method: str = "natural"
    size: int = 6000
    small: int = 16000
    overlap: int = 0
    target: int = 8000
    image_tokens: int = 1200


@dataclass(frozen=True)
class PoolConfig:
    strategy: str = "average"
    threshold: float = 0.8
    recall: float = 0.999


@dataclass(frozen=True)
class DetectConfig:
    """Rules by class, the confidence of a hit, the least severity that is kept."""

    rules: Mapping[str, list[str]] = field(default_factory=lambda: patterns.PATTERNS)
    confidence: float = patterns.CONFIDENCE
    least_severity: int = 1


@dataclass(frozen=True)
class FindingsConfig:
    """A finding goes if one with the same text is at most ``gap`` lines before it; at most ``top`` stay in a document (None: all)."""

    gap: int = 1
    top: int | None = None


@dataclass(frozen=True)
class AuditConfig:
    chunk: ChunkConfig = ChunkConfig()
    pool: PoolConfig = PoolConfig()
    detect: DetectConfig = DetectConfig()
    findings: FindingsConfig = FindingsConfig()


def override(config: T, partial: Mapping[str, Any]) -> T:
    """``config`` with the values of ``partial``, which may leave out any field; mappings override nested configurations in part.

    The given configuration stays as it is. A name that it does not have raises TypeError.
    """
    known = {f.name for f in fields(config)}  # type: ignore[arg-type]
    if extra := sorted(set(partial) - known):
        raise TypeError(f"{type(config).__name__} has no {', '.join(extra)}")
    own = {k: override(getattr(config, k), v) if is_dataclass(getattr(config, k)) and isinstance(v, Mapping) else v for k, v in partial.items()}
    return replace(config, **own)  # type: ignore[type-var]


def chunk(rows: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Documents (or pages, for the method pages) cut as the configuration says."""
    if config.method == "natural":
        return chunking.chunk_natural(rows, config.size)
    if config.method == "adaptive":
        return chunking.chunk_adaptive(rows, config.small, config.overlap)
    if config.method == "pages":
        return chunking.pack_pages(rows, config.target, config.image_tokens)
    raise ValueError(f"no method {config.method!r}")


def pool(chunks: DataFrame, config: PoolConfig = PoolConfig()) -> DataFrame:
    return embed.pool(chunks, config.strategy)


def audit_lines(lines: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """The findings of each document's lines, severest first (column rank), then in order of line, pattern and hit.

    Of hits of one class with equal text, those that follow another within ``gap`` lines go: a gap in the run of such hits
    starts a new one. Nothing of a document is collected; both steps are windows.
    """
    hits = patterns.severe(patterns.detect_patterns(lines, dict(config.detect.rules), config.detect.confidence), config.detect.least_severity)
    place = [F.col(c) for c in ("line_no", "pass_no", "pattern_no", "hit_no")]
    before = F.lag("line_no").over(Window.partitionBy("doc_id", "error_type", "hit").orderBy(*place))
    kept = hits.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("line_no") - F.col("_before") > config.findings.gap)).drop("_before")
    order = [F.desc("severity"), *place]
    if config.findings.top is not None:
        return issues.top_k(kept, ["doc_id"], order, config.findings.top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
