"""Data-quality and ETL analytics expressed as Spark DataFrame plans."""

from sievework.session import build_session, settle

__all__ = ["build_session", "settle"]
