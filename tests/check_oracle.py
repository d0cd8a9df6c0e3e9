"""Run registered queries against their SQL checks: python tests/check_oracle.py [folder] [name...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from volpanel.registry import load  # noqa: E402
from volpanel.session import local_session  # noqa: E402
from volpanel.sources.views import TABLES  # noqa: E402


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
                out.append(str(list(v)))
            elif isinstance(v, dict):
                out.append(str(sorted(v.items())))
            elif v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~null")
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append(repr(float(v)))
            elif hasattr(v, "item") and not hasattr(v, "isoformat"):
                out.append(str(v.item()) if isinstance(v.item(), bool) else repr(float(v)))
            elif hasattr(v, "isoformat"):
                out.append(v.isoformat().replace("T00:00:00", ""))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = []
    for name, q in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t0 = time.time()
            left = q.run(spark, folder).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name} rows={len(left)} spark={t1 - t0:.1f}s", flush=True)
                continue
            right = con.execute(q.sql).df()
            t2 = time.time()
            a, b = canonical(left), canonical(right)
            ok = a == b and sorted(left.columns) == sorted(right.columns)
            print(f"{'ok   ' if ok else 'FAIL '} {name} rows={len(a)}/{len(b)} "
                  f"spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
            if not ok:
                failed.append(name)
                print("   cols", sorted(left.columns))
                sa, sb = set(a), set(b)
                for r in sorted(sa - sb)[:3]:
                    print("   spark", r)
                for r in sorted(sb - sa)[:3]:
                    print("   duck ", r)
                print("   only spark", len(sa - sb), "only duck", len(sb - sa))
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print("ERROR", name, str(e)[:500], flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
