"""python -m tessera run|check|compare|init|version: exit code 0, or 2 with what is wrong."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("run", "check"):
        s = sub.add_parser(name)
        s.add_argument("--config", required=True)
        s.add_argument("--out")
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("init")
    s.add_argument("--metadata", required=True)
    s.add_argument("--calls")
    s.add_argument("--readings")
    s = sub.add_parser("compare")
    for name in ("input", "id-column", "outcome", "label-a", "label-b"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--out")
    for name, value in (("folds", 5), ("repeats", 20), ("permutations", 999), ("draws", 999)):
        s.add_argument(f"--{name}", type=int, default=value)
    sub.add_parser("version")
    a = p.parse_args(args)
    if a.what == "version":
        from tessera.plans.run import VERSION

        print(f"tessera {VERSION}")
        return 0
    from pyspark.sql import SparkSession

    from tessera.config import ConfigError, load
    from tessera.draft import draft
    from tessera.operators import ingest
    from tessera.plans import run

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        if a.what == "init":
            print(draft(spark, a.metadata, a.calls, a.readings))
            return 0
        if a.what == "compare":
            _, contrasts = run.compare_labelings(spark, a.input, a.id_column, a.outcome, a.label_a, a.label_b, a.out, a.folds, a.repeats, a.permutations, a.draws)
            contrasts.show(truncate=False)
            return 0
        cfg = load(a.config)
        if a.what == "check":
            print(json.dumps(run.check(spark, cfg, a.out), ensure_ascii=False, indent=1, default=float))
            return 0
        df = run.run(spark, cfg, a.out)
        if a.json:
            print(json.dumps([r.asDict() for r in run.status_summary(df).orderBy("analysis").collect()]))
        else:
            df.select("level", "feature", "analysis", "status", "estimate", "lower", "upper", "q", "conclusion").orderBy("level", "feature", "analysis").show(200, truncate=False)
        return 0
    except (OSError, ConfigError, ingest.Refused, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
