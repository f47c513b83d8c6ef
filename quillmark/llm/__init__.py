"""Operators of a training-data pipeline, one module each (``op1_*`` ... ``op10_*`` are
the registered queries).  Nothing else in the library imports this subpackage."""
