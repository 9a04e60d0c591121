"""Operators over the canonical tables of ``hexflow.schema``."""
