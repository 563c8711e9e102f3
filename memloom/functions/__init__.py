"""Column builders: everything here is a Catalyst expression unless it lives in ``udfs``."""
