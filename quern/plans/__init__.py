"""Registered queries: whole plans over the provided tables, each with the SQL it must agree with where SQL can say it."""

from . import corpus, manifests, misc, registry, scores, sources, training  # noqa: F401
