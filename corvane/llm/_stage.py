"""Tables that cut lineage, written to the folder that driver and executors share."""

from corvane.sources.shared import shared_dir, staged

__all__ = ["shared_dir", "staged"]
