"""Fitting on streams."""

from tabulon.streaming.incremental import fit_stream, running_moments

__all__ = ["fit_stream", "running_moments"]
