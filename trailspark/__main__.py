"""``python -m trailspark JOB ...``: the jobs of ``trailspark.plans.jobs``, their parameters as options."""

from __future__ import annotations

import argparse
import inspect
import typing

from trailspark.plans import jobs

JOBS = {f.__name__: f for f in (jobs.map_tracks, jobs.map_simulated, jobs.reduce_data, jobs.analyse, jobs.fit, jobs.walk, jobs.sweep, jobs.adjacency)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailspark", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    for name, f in JOBS.items():
        s = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        kinds = typing.get_type_hints(f)
        for a in list(inspect.signature(f).parameters.values())[1:]:
            kind = kinds[a.name]
            known = [k for k in typing.get_args(kind) if k is not type(None)] if typing.get_origin(kind) not in (None, Sequence_) else []
            plain = known[0] if known else kind
            if typing.get_origin(kind) is Sequence_:
                s.add_argument(f"--{a.name}", nargs="*", type=typing.get_args(kind)[0], default=None if a.default is a.empty else list(a.default), required=a.default is a.empty)
            elif plain is bool:
                s.add_argument(f"--{a.name}", action=argparse.BooleanOptionalAction, default=a.default)
            elif a.default is a.empty:
                s.add_argument(a.name, type=plain)
            else:
                s.add_argument(f"--{a.name}", type=plain, default=a.default)
    return p


Sequence_ = typing.get_origin(typing.Sequence[int])


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    options = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("trailspark").getOrCreate()
    JOBS[options.pop("job")](spark, **options)


if __name__ == "__main__":
    main()
