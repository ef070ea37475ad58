"""DataFrame operators: detection, lineage, decisions, traces, stop scans, reports."""
