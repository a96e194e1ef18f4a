"""Evidence-gated market analytics expressed as Spark DataFrame jobs."""

from plumbline.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
