"""Write the formatted physical plans of the headline queries to docs/PLANS.md.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["thread_metadata", "thread_summary", "message_sequence", "dashboard_cards", "report_lines"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from threadlens.plans import catalog
    from threadlens.session import local_session

    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan, not AQE's runtime rewrite
    out = ["# Physical plans of the headline queries", "",
           "Generated by `tools/plans.py` (AQE off to show the static plan; at run time AQE may turn",
           "small joins into broadcast joins after measuring their size).  Features and thread metadata",
           "appear as a parquet scan of the written feature table and a checkpointed scan (`Scan ExistingRDD`).", ""]
    for name in NAMES:
        buf = io.StringIO()
        with redirect_stdout(buf):
            catalog.QUERIES[name](spark, sf).explain("formatted")
        out += [f"## {name}", "", "```", buf.getvalue().rstrip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write(("\n".join(out) + "\n").replace("\x00", "\\u0000"))
    print(path)


if __name__ == "__main__":
    main()
