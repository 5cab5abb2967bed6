"""Write the formatted physical plans of a few catalogue queries to docs/PLANS.md.

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featmart.plans.catalog import RAW  # noqa: E402
from featmart.session import get_spark  # noqa: E402

NAMES = ["customer_mart", "join_back", "seq_diff_running", "dist_pack", "first_last_k", "one_hot_counts"]


def main(sf_dir: str) -> None:
    spark = get_spark("local[8]", shuffle_partitions=16)
    out = ["# Physical plans", "",
           f"`explain('formatted')` of selected catalogue queries on `{sf_dir}` (initial adaptive plan; AQE may",
           "still switch join strategies at run time). Generated by `tools/dump_plans.py`.", ""]
    for n in NAMES:
        df = RAW[n](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        out += [f"## {n}", "", "```", plan.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
