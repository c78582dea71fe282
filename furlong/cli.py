"""Command line: scrape result pages into the standard layer, convert the raw CSV files, integrate, validate, train, and show what there is."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
from collections.abc import Callable

from furlong.session import get_session

RAW, STANDARD = "data/raw/pages", "data/standard"


def day(text: str) -> datetime.date:
    try:
        return datetime.date.fromisoformat(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text!r} is not a date (YYYY-MM-DD)") from e


def named(text: str) -> Callable:
    """The callable that module:name names."""
    module, _, name = text.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"{text!r} names no callable (module:name)") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="furlong", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scrape", help="save, parse and store the result pages of a range of days")
    s.add_argument("--start", type=day, required=True)
    s.add_argument("--end", type=day, required=True)
    s.add_argument("--base", required=True, help="address of the site")
    s.add_argument("--transport", type=named, help="module:name of a callable from an address to a page; default: plain HTTP")
    s.add_argument("--max-races", type=int)
    s.add_argument("--raw-dir", default=RAW)
    s.add_argument("--standard-dir", default=STANDARD)
    c = sub.add_parser("convert", help="raw CSV files to tables")
    c.add_argument("--raw-dir", required=True)
    c.add_argument("--standard-dir", default=STANDARD)
    c.add_argument("--core-dir")
    for name, text in (("integrate", "both sources to one corpus"), ("status", "what has been scraped")):
        sub.add_parser(name, help=text).add_argument("--standard-dir", default=STANDARD)
    f = sub.add_parser("features", help="the feature tables")
    f.add_argument("--standard-dir", default=STANDARD)
    f.add_argument("--feature-dir", default="data/feature")
    v = sub.add_parser("validate", help="check the tables")
    v.add_argument("--raw-dir", required=True)
    v.add_argument("--standard-dir", default=STANDARD)
    t = sub.add_parser("train", help="the training run")
    t.add_argument("--config", required=True)
    return p


def status(spark, standard_dir: str, out: Callable[[str], None] = print) -> None:
    from furlong.sources.tables import month_summary

    root = f"{standard_dir}/scraped"
    rows = month_summary(spark, root).collect()  # a few rows a month
    if not rows:
        out("no scraped data yet")
        return
    total = {r.table: r for r in rows if r.month is None}
    out(f"scraped data in {root}")
    out("rows: " + " ".join(f"{t}={total[t].rows if t in total else 0}" for t in ("race", "entry", "result")))
    races = {r.month: r.rows for r in rows if r.month and r.table == "race"}
    out("month    files  race_rows")
    for r in sorted((r for r in rows if r.month and r.table is None), key=lambda r: r.month):
        out(f"{r.month:<8} {r.tables:<6} {races.get(r.month, 0)}")
    if "race" in total and total["race"].first_day:
        out(f"race_date: {total['race'].first_day} ~ {total['race'].last_day}")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_session()
    if a.command == "scrape":
        from furlong.sources.scrape import Session, scrape

        with Session(a.transport) if a.transport else Session() as transport:
            done = scrape(spark, a.start, a.end, transport, a.base, a.raw_dir, a.standard_dir, a.max_races)
        print("scraped, months written: " + " ".join(f"{t}={len(done[t].rows) if t in done else 0}" for t in ("race", "entry", "result")))
    elif a.command == "convert":
        from furlong.plans.convert import convert

        print(json.dumps(convert(spark, a.raw_dir, a.standard_dir, a.core_dir), indent=2))
    elif a.command == "integrate":
        from furlong.plans.integrate import integrate_standard_layer

        print(json.dumps(integrate_standard_layer(spark, a.standard_dir), indent=2))
    elif a.command == "features":
        from furlong.plans.features import write

        print(json.dumps(write(spark, a.standard_dir, a.feature_dir), indent=2))
    elif a.command == "validate":
        from furlong.quality.validate import run_all

        found = run_all(spark, a.raw_dir, a.standard_dir)
        print(json.dumps(found, indent=2, ensure_ascii=False, default=str))
        return 0 if found["overall_pass"] else 1
    elif a.command == "train":
        from furlong.ml.run import run_train

        print(json.dumps(run_train(spark, a.config), indent=2, default=str))
    else:
        status(spark, a.standard_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
