"""Execution plans for recursive network computations."""

from thalweg.plans.contract import ascend, descend
from thalweg.plans.store import saved

__all__ = ["ascend", "descend", "saved"]
