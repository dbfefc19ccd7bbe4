"""Command line: python tests/run_queries.py <sf> [key ...] compares the named (or all) queries with their SQL."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry.plans import registry
from basketry.runtime import local_session
from tests.compare import compare, database


def main() -> int:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    areas = [w[1:] for w in wanted if w.startswith("@")]
    if areas:
        registry.AREAS[:] = areas
        wanted = [w for w in wanted if not w.startswith("@")]
    registry.load_all()
    spark = local_session("compare")
    con = database(sf_dir)
    bad = 0
    for key, fn in registry.QUERIES.items():
        if wanted and key not in wanted:
            continue
        try:
            ok, text, ours, theirs = compare(spark, sf_dir, fn, registry.ORACLES.get(key), con)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, text, ours, theirs = False, f"{type(error).__name__}: {str(error)[:700]}", 0, 0
        bad += ok is False
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'BAD '} {key:28s} {ours:6.2f}s {theirs:6.2f}s {text}", flush=True)
    print(f"{bad} bad of {len(registry.QUERIES)}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
