"""Whole jobs composed from the operators."""

from flowprofile.plans.profiling import Profiled, profile_clusters, run

__all__ = ["Profiled", "profile_clusters", "run"]
