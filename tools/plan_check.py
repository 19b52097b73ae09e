"""List plan operators that would not survive a large input.

Flags Cartesian products, nested-loop joins and windows without partitioning.
A window over an already aggregated, bounded table is fine; the report names
the query so a reader can judge.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parcelwise.session import local_session  # noqa: E402
from workloads import registry  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    for name, query in registry.collect("QUERIES").items():
        buffer = io.StringIO()
        with contextlib.redirect_stdout(buffer):
            query(spark, sf_dir).explain("simple")
        text = buffer.getvalue()
        found = {k: len(re.findall(k, text)) for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition")}
        windows = len(re.findall(r"Window \[.*?\], \[[^\[\]]*(?:ASC|DESC)", text))
        flags = {k: v for k, v in found.items() if v}
        print(name, "exchanges", len(re.findall(r"Exchange hash", text)), "windows", windows, flags or "")


if __name__ == "__main__":
    main()
