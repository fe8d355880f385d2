"""Importing this package registers every query."""

from loomframe.plans.catalog import (  # noqa: F401
    detection,
    elementwise,
    features,
    learning,
    reductions,
    sampling,
    shapes,
    sources,
    streams,
    text,
    training,
)
