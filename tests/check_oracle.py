"""Run all queries against DuckDB: python tests/check_oracle.py [sf_dir] [name-part ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry_module
from oracle import compare, connect
from replyloom.session import local_session


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                n, problems = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                n, problems = len(fn(spark, sf_dir).collect()), []
        except Exception as error:
            n, problems = 0, ["".join(traceback.format_exception_only(error))[:1500]]
        failed += bool(problems)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok':4} {name:40} {kind:6} rows={n} {time.time() - start:.1f}s",
              flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
