"""Imports every module that registers queries."""

from . import boards, finding, guards, live, loading, loyalty, money, reports  # noqa: F401
