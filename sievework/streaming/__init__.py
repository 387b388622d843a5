"""Incremental forms: ingest with a quality gate, duplicate removal, SLA windows, dashboards."""
