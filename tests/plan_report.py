"""Condensed physical plans of key queries (operators, keys, pruned scans).

    python -m tests.plan_report [/root/testdata/sf0.1] > PLANS.body.md
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

KEY_QUERIES = ["parse_logs", "byte_offsets", "hot_run_offsets", "status_transitions", "fire_adherence",
               "expand_cron", "node_results", "check_report", "severity_rank", "plan_order"]


def condense(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        if not line.strip() or line.startswith("=="):
            continue
        m = re.match(r"^([\s:+\-*]*)(.*)$", line)
        prefix, body = m.group(1), m.group(2)
        op = re.split(r"[ (\[]", body, 1)[0]
        if op.startswith("Exchange"):
            part = re.search(r"(hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition|RoundRobinPartitioning)", body)
            body = f"Exchange {part.group(1) if part else ''}"
        elif op == "FileScan":
            loc = re.search(r"/([a-z_]+)\.parquet\]", body)
            schema = re.search(r"ReadSchema: struct<([^>]*)>", body)
            cols = ",".join(re.findall(r"([a-z_]+):", schema.group(1))) if schema else ""
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", body)
            body = f"FileScan {loc.group(1) if loc else ''} cols=[{cols}] pushed=[{pushed.group(1) if pushed else ''}]"
        elif op in ("Window", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "HashAggregate",
                    "SortAggregate", "ObjectHashAggregate", "WindowGroupLimit", "Generate", "Expand"):
            keys = re.findall(r"\[([^\[\]]{0,160})\]", body)
            body = f"{op} {' '.join('[' + k + ']' for k in keys[:3])}"
        else:
            body = op
        body = re.sub(r"#\d+L?", "", body)
        out.append(prefix + body[:230])
    return "\n".join(out)


def main(sf: str) -> None:
    sys.path.insert(0, ".")
    from runlake.session import local_session
    import __spark_entry__ as entry
    spark = local_session()
    qs = entry.queries()
    for name in KEY_QUERIES:
        df = qs[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        print(f"### `{name}`\n\n```\n{condense(buf.getvalue())}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
