"""Write PLANS.md: physical plans of representative registered queries (python tests/dump_plans.py)."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SHOW = ["keep_columns", "semi_join_cluster_members", "binary_conversion", "impute_mean",
        "add_row_index", "nearest_center", "inertia", "count_nulls", "undersample_majority"]


def main(sf_dir="/root/testdata/sf0.1"):
    import __spark_entry__ as E
    from flawscope.session import build_session

    spark = build_session(8, 8)
    qs = E.queries()
    out = ["# Physical plans of representative queries\n",
           f"Generated by `tests/dump_plans.py` on `{sf_dir}` (AQE initial plans; Spark 4.1).\n"]
    for name in SHOW:
        plan = qs[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        out += [f"\n## {name}\n", "```", plan.strip(), "```"]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
