"""The feature registry: nine features of a trailing window, each with a transform; operators/features.py computes them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG1P, IDENTITY = "log1p", "identity"

#: Predicates over events by name.
PREDICATES: dict[str, Callable[[], Column]] = {
    "is_html": lambda: F.col("resource_type") == "html",
    "is_4xx_response": lambda: F.col("status_code").between(400, 499),
    "has_referrer": lambda: F.col("referrer_present"),
}


@dataclass(frozen=True)
class Feature:
    """What identifies a feature: its name, what it measures of the events in a window, and the transform before binning."""

    name: str
    kind: str
    transform: str
    field: str = ""
    numerator: str = ""
    denominator: str = ""
    event_filter: str = ""

    def identity(self) -> tuple[str, ...]:
        return (self.name, self.kind, self.transform, self.field, self.numerator, self.denominator, self.event_filter)


REGISTRY = (
    Feature("window_request_count", "count", LOG1P),
    Feature("window_span_seconds", "numeric", LOG1P),
    Feature("mean_inter_request_gap_ms", "numeric", LOG1P, event_filter="is_html"),
    Feature("inter_request_gap_cv", "numeric", IDENTITY, event_filter="is_html"),
    Feature("distinct_endpoints_hit", "distinct_count", LOG1P, field="uri"),
    Feature("html_to_asset_ratio", "ratio", IDENTITY, numerator="is_html", denominator="window_request_count"),
    Feature("error_4xx_rate", "ratio", IDENTITY, numerator="is_4xx_response", denominator="window_request_count"),
    Feature("method_entropy", "entropy", IDENTITY, field="http_method"),
    Feature("has_referrer_ratio", "ratio", IDENTITY, numerator="has_referrer", denominator="window_request_count"),
)
NAMES = tuple(f.name for f in REGISTRY)


def registry_hash(registry: tuple[Feature, ...] = REGISTRY) -> str:
    """SHA-256 over the identities, each field behind its length in eight bytes."""
    h = hashlib.sha256()
    for f in registry:
        for part in f.identity():
            h.update(len(part.encode()).to_bytes(8, "big") + part.encode())
    return h.hexdigest()


def transformed(value: Column, transform: str) -> Column:
    """value under a named transform; an unknown name is an error."""
    if transform == LOG1P:
        return F.log1p(value)
    if transform == IDENTITY:
        return value
    raise ValueError(f"unknown transform: {transform}")
