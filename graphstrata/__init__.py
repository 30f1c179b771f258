"""Layered property-graph analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"


def version() -> str:
    return __version__
