"""Document-sensitivity analytics as plain PySpark DataFrame operators."""

from sealgrade.session import get_session, scratch_dir, stage

__all__ = ["get_session", "scratch_dir", "stage"]
