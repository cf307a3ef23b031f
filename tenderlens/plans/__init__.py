"""Mapping of the test tables to the audit tables, and the registered queries."""
