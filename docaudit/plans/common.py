"""How queries get their tables."""

from ..fixtures import view


def over(f, *names):
    """A query that applies ``f`` to derived tables."""
    return lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))


def raw(name: str, f):
    """A query that applies ``f`` to a given table."""
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
