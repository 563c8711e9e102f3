"""Readers and sinks: nested dialogue JSON, JSON lists, memory tables, traces, flat files."""
