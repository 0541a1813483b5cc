"""Readers and writers: flow tables, samples and model tables."""

from flowprofile.sources.flows import load_flows, separate_labels, validate_schema, write_sample

__all__ = ["load_flows", "separate_labels", "validate_schema", "write_sample"]
