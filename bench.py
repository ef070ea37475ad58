"""Time the headline queries; prints one JSON line.

Each query runs in full into a sink that drops its rows.  ``BENCH_REPEATS`` runs
are made, three by default; their median is reported, and their minimum beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tracewarden.plans.registry import QUERIES
from tracewarden.plans.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "validate_command", "validate_command_counts", "validate_tool_input", "pii_findings", "contains_pii", "secret_findings",
    "dangerous_hits", "mcp_param_scan", "shell_tokens", "shell_read_paths",
    "shell_read_secret_join", "claude_pre_tool", "claude_post_tool", "cursor_before_shell",
    "cursor_after_edit", "openclaw_before_tool", "decisions", "traces_flat", "range_positions",
    "edited_set", "stop_status", "vulnerability_rollup", "flow_edges", "duration_percentiles",
    "read_hook_events", "log_traces", "edited_stream", "trace_stream",
]


def run(spark, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS, "bench")
    times, least = {}, {}
    for name in names:
        runs = [run(spark, name) for _ in range(REPEATS)]
        times[name], least[name] = round(statistics.median(runs), 3), round(min(runs), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "minimum": least,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "repeats": REPEATS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
