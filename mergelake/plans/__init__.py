"""Policies, guards, clocks and the registered queries."""
