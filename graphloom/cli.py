"""``python -m graphloom.cli INPUT.csv OUTPUT.csv``: ranks of an edge CSV."""

from __future__ import annotations

import os
import sys

from .errors import EXIT_INTERNAL, EXIT_OK, EXIT_SYSTEM, EngineError, NonConverged, NumericalError, UsageError

USAGE = "usage: main INPUT.csv OUTPUT.csv\n       main --help\n"


def execute(source: str, target: str, config_path: str = "config/main.conf", spark=None) -> None:
    from pyspark.sql import SparkSession

    from .plans.pagerank import Graph, run
    from .sources.config import load_config
    from .sources.edge_csv import InputGuard, read_edge_csv
    from .sources.rank_csv import check_output, write_rank_csv

    config = load_config(config_path)
    check_output(target)
    guard = InputGuard(source)
    own = spark is None
    if own:
        builder = SparkSession.builder.appName("graphloom")
        for key, value in config.spark_conf.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    try:
        graph = Graph.build(read_edge_csv(spark, f"file://{os.path.abspath(source)}"))
        guard.verify()
        report, ranks = run(graph, config.rank, edge_slice_size=config.tasks.edge_slice_size)
        if report.status == "numerical_failure":
            raise NumericalError(report.failure)
        if ranks is None:
            raise NonConverged(f"no convergence in {report.iterations} iterations")
        write_rank_csv(ranks, target)
    finally:
        if own:
            spark.stop()


def main(argv: list[str], spark=None) -> int:
    try:
        if argv == ["--help"]:
            sys.stdout.write(USAGE)
            return EXIT_OK
        if len(argv) != 2:
            raise UsageError("expected INPUT.csv and OUTPUT.csv")
        execute(*argv, spark=spark)
        return EXIT_OK
    except EngineError as e:
        kind, code, said = e.kind, e.code, str(e)
    except OSError as e:
        kind, code, said = "system", EXIT_SYSTEM, str(e)
    except Exception as e:  # noqa: BLE001  the last line of defence of a command
        kind, code, said = "internal", EXIT_INTERNAL, str(e)
    sys.stderr.write(f"main: {kind}: {' '.join(said.split())}\n")
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
