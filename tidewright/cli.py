"""python -m tidewright.cli TABLE [-o DIR] [--report FILE] [--plan FILE] [--recipe FILE] [--trace DIR]"""

from __future__ import annotations

import argparse
import sys
import time

from . import clean
from .plans import ir, report
from .session import session
from .sources.tables import read_table, write_csv


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    p.add_argument("table")
    p.add_argument("-o", "--out")
    p.add_argument("--report")
    p.add_argument("--plan")
    p.add_argument("--recipe", help="a plan to replay, in place of planning")
    p.add_argument("--trace")
    a = p.parse_args(argv)
    spark, began = session(), time.time()
    try:
        table = read_table(spark, a.table)
    except Exception as why:
        print(f"can't read {a.table}: {str(why).splitlines()[0]}", file=sys.stderr)
        return 1
    plan = None
    if a.recipe:
        with open(a.recipe, encoding="utf-8") as f:
            plan = ir.read(f.read())
    got = clean(table, plan)
    log = got.applied.log()
    if a.out:
        write_csv(got.applied.rows, a.out)
    if a.plan:
        with open(a.plan, "w", encoding="utf-8") as f:
            f.write(ir.serialize(got.plan))
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(report.markdown(got.plan, log, got.before))
    if a.trace:
        report.append_trace(spark, a.trace, report.trace(got.plan, log, got.before.n_rows, began))
    print(f"{got.before.n_rows} rows, {sum(e.get('cells_changed', 0) for e in log)} cells changed, {len(got.plan.get('flags', []))} flags")
    return 0


if __name__ == "__main__":
    sys.exit(main())
