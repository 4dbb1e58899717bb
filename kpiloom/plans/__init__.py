"""Dimensions, cleaned facts (``Model``) and report compositions."""

from kpiloom.plans.facts import Model  # noqa: F401
