"""Stages from the command line: `python -m wfscan list`, `python -m wfscan run QUERY TABLES OUT`, and code similarity in stages.

    python -m wfscan similarity signatures FILES.parquet OUT       signatures of all files
    python -m wfscan similarity cluster SIGNATURES OUT             classes and similar pairs
    python -m wfscan similarity filter SIGNATURES CLUSTERS OUT     packages by the similarity of their files
    python -m wfscan similarity all FILES.parquet OUT              the three in turn
"""

from __future__ import annotations

import argparse

from wfscan.operators import similarity as sim
from wfscan.session import session


def _signatures(spark, files: str, out: str, a) -> None:
    f = spark.read.parquet(files).select("file_id", a.package, "code")
    sim.signatures(f, ["file_id", a.package], hashes=a.hashes).write.mode("overwrite").parquet(out)


def _cluster(spark, signatures: str, out: str, a) -> None:
    members, links = sim.similar_signatures(spark.read.parquet(signatures), "file_id", a.least, a.bands, a.hashes // a.bands)
    members.write.mode("overwrite").parquet(f"{out}/members")
    links.write.mode("overwrite").parquet(f"{out}/links")


def _filter(spark, signatures: str, clusters: str, out: str, a) -> None:
    members, links = spark.read.parquet(f"{clusters}/members"), spark.read.parquet(f"{clusters}/links")
    pairs = sim.package_pairs(members, links, spark.read.parquet(signatures), "file_id", a.package, a.package_least)
    sim.top_pairs(pairs, a.package_least, a.top or None).write.mode("overwrite").json(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wfscan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    s = sub.add_parser("similarity")
    s.add_argument("stage", choices=("signatures", "cluster", "filter", "all"))
    s.add_argument("paths", nargs="+")
    s.add_argument("--package", default="npm_name")
    s.add_argument("--hashes", type=int, default=sim.HASHES)
    s.add_argument("--bands", type=int, default=sim.BANDS)
    s.add_argument("--least", type=float, default=sim.LEAST)
    s.add_argument("--package-least", type=float, default=0.5)
    s.add_argument("--top", type=int, default=0)
    a = p.parse_args(argv)
    if a.command == "list":
        from wfscan.plans import QUERIES

        print("\n".join(sorted(QUERIES)))
        return
    spark = session("wfscan")
    if a.command == "run":
        from wfscan.plans import QUERIES

        QUERIES[a.query](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.stage == "all":
        files, out = a.paths
        _signatures(spark, files, f"{out}/signatures", a)
        _cluster(spark, f"{out}/signatures", f"{out}/clusters", a)
        _filter(spark, f"{out}/signatures", f"{out}/clusters", f"{out}/packages", a)
    else:
        {"signatures": _signatures, "cluster": _cluster, "filter": _filter}[a.stage](spark, *a.paths, a)


if __name__ == "__main__":
    main()
