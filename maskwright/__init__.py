"""Corpus-scale reversible PII masking and text analytics on Spark."""

__version__ = "0.1.0"

from .operators.restore import load_mapping, restore, save_mapping, unknown
from .operators.spans import Span
from .plans.masking import PipelineConfig, Result, mask, mask_documents

__all__ = ["PipelineConfig", "Result", "Span", "load_mapping", "mask", "mask_documents", "restore", "save_mapping", "unknown"]
