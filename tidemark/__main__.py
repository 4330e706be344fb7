"""Command line: `python -m tidemark config default|validate`, `doctor`, `bench`.

Exit codes: 0 done, 1 an error, 2 host checks failed, 3 something that Spark does not drive.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from . import doctor
from .errors import DoctorError, TidemarkError, UnsupportedError
from .sources import config


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--trace-json", action="store_true", help="events as lines of JSON on standard error")
    top = p.add_subparsers(dest="command", required=True)
    c = top.add_parser("config").add_subparsers(dest="what", required=True)
    c.add_parser("default").add_argument("--output")
    c.add_parser("validate").add_argument("--file", required=True)
    b = top.add_parser("bench", help="append, scan and compact a table of generated trades")
    b.add_argument("--path", required=True)
    b.add_argument("--rows-per-batch", type=int, default=10_000)
    b.add_argument("--batches", type=int, default=1000)
    b.add_argument("--scan-iterations", type=int, default=10)
    b.add_argument("--compact", action="store_true")
    b.add_argument("--history")
    b.add_argument("--backend", choices=("table", "uring", "spdk", "dpdk"), default="table")
    d = top.add_parser("doctor", help="check the host")
    d.add_argument("--require-hugepages", action="store_true")
    d.add_argument("--folder", action="append", default=[], help="must be there")
    d.add_argument("--pci", action="append", default=[], help="a device's address")
    x = p.parse_args(args)
    trace(x.trace_json)
    try:
        if x.command == "doctor":
            failed = doctor.report(doctor.checks(x.require_hugepages, x.folder, x.pci))
            if failed:
                raise DoctorError(f"{failed} host checks failed")
        elif x.command == "bench" and x.backend != "table":
            raise UnsupportedError(f"{x.backend} has no counterpart on Spark")
        elif x.command == "bench":
            bench(x)
        elif x.what == "default":
            text = config.to_toml(config.Config())
            if x.output:
                with open(x.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, end="")
        else:
            config.load(x.file)
            print(f"{x.file}: valid")
    except (TidemarkError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, DoctorError) else 3 if isinstance(e, UnsupportedError) else 1
    return 0


LOG = logging.getLogger("tidemark")


def trace(as_json: bool) -> None:
    """Events to standard error, as lines of JSON or of text."""
    line = logging.StreamHandler()
    if as_json:
        line.format = lambda r: json.dumps({"timestamp": r.created, "level": r.levelname, "message": r.getMessage(), "fields": getattr(r, "fields", {})})
    LOG.handlers = [line]
    LOG.setLevel(logging.INFO if as_json else logging.WARNING)


def bench(x: argparse.Namespace) -> None:
    """Each phase prints its rate; with a history file also the change since the last run."""
    from pyspark.sql import SparkSession, functions as F

    from .operators.predicates import RangePredicate
    from .sources import history
    from .sources.generate import TRADES, trades
    from .sources.table import Table

    spark = SparkSession.builder.getOrCreate()
    t, total = Table.open(spark, x.path, TRADES), x.rows_per_batch * x.batches

    def phase(name: str, unit: str, run) -> None:
        began = time.perf_counter()
        units = run()
        seconds = max(time.perf_counter() - began, sys.float_info.epsilon)
        LOG.info(name, extra={"fields": {"units": units, "unit": unit, "seconds": seconds}})
        print(f"{name}: {units} {unit} in {seconds:.3f} s, {units / seconds:.1f} a second")
        if x.history:
            row = (name, unit, units, None, int(seconds * 1000), units / seconds, None, [("rows_per_batch", x.rows_per_batch), ("batches", x.batches)], time.time_ns() // 1_000_000)
            history.append_history(spark.createDataFrame([row], history.SCHEMA), x.history)
            mine = history.read_history(spark, x.history).where(F.col("benchmark") == name)
            last = history.deltas(mine, "benchmark", F.col("timestamp_ms"), "rate_per_sec").orderBy(F.desc("timestamp_ms")).first()
            if last["delta_percent"] is not None:
                print(f"  before: {last['previous']:.1f} a second ({last['delta_percent']:+.1f} %)")

    def append() -> int:
        n = sum(t.append(trades(spark, x.rows_per_batch, i * x.rows_per_batch)) for i in range(x.batches))
        t.flush()
        return n

    phase("db_append", "rows", append)
    phase("db_scan_time_range", "rows", lambda: sum(t.scan_time_range(0, total).count() for _ in range(x.scan_iterations)))
    phase("db_scan_predicate", "rows", lambda: sum(t.scan_where(0, total, RangePredicate("price", 100.0, 110.0)).count() for _ in range(x.scan_iterations)))
    if x.compact:
        ids = [s.id for s in t.manifest.sealed_segments]
        phase("db_compact", "segments", lambda: len(ids) if t.compact(ids) else 0)


if __name__ == "__main__":
    sys.exit(main())
