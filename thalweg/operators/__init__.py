"""Operators on flow networks."""

from thalweg.operators.network import FlowNetwork

__all__ = ["FlowNetwork"]
