"""Trip-time analytics on Spark: cleaning, enrichment, point-in-time features, quantile promises, calibration, streaming state."""

from tripspark.config import Settings
from tripspark.session import build_session

__all__ = ["Settings", "build_session"]
