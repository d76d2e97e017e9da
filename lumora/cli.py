"""python -m lumora.cli: runs an experiment on a dataset and writes its report."""

from __future__ import annotations

import argparse

from lumora.experiment import Experiment
from lumora.report import save
from lumora.session import session
from lumora.sources.catalog import load


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", choices=("orders", "simulated", "ratings", "all"), default="simulated", help="all: each dataset in turn, ratings if files are named")
    p.add_argument("--path", default="/root/testdata/sf0.01", help="folder of the order tables")
    p.add_argument("--ratings", nargs="*", default=[], metavar="VERTICAL=CSV", help="rating files of the dataset ratings")
    p.add_argument("--rounds", type=int, default=4)
    p.add_argument("--time-budget", type=float, default=None, help="seconds after which no further round begins")
    p.add_argument("--out", default="runs/latest")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--sim-users", type=int, default=600)
    p.add_argument("--rho", type=float, default=0.55)
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    spark = session()
    options = {"orders": {"sf_dir": a.path}, "simulated": {"n_users": a.sim_users, "rho": a.rho, "seed": a.seed}}
    if a.ratings:
        options["ratings"] = {"paths": dict(r.split("=", 1) for r in a.ratings), "seed": a.seed}
    if a.dataset != "all" and a.dataset not in options:
        p.error("--dataset ratings needs --ratings VERTICAL=CSV ...")
    for name in options if a.dataset == "all" else (a.dataset,):
        out = f"{a.out}/{name}" if a.dataset == "all" else a.out
        run = Experiment(load(spark, name, **options[name]), a.rounds, a.time_budget, a.seed).run()
        save(spark, run, out)
        if not a.quiet:
            print(f"{name}: champion: {run.decision.get('champion')}; stopped: {run.stopped}; written to {out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
