"""Run registered queries against their SQL: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import compare, connect  # noqa: E402

from lorekeep import registry  # noqa: E402
from lorekeep.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = registry.oracle_sql()
    failed = []
    for name, run in registry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problems = compare(df, con, sql[name])
                note = f"rows {df.count()}" if args else ""
            else:
                problems, note = [], f"rows {df.count()} (no SQL)"
        except Exception as error:  # noqa: BLE001
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
            if len(args) == 1:
                traceback.print_exc()
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("    ", p[:1500], flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)


main()
