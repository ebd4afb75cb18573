"""revlens: code-review analytics on Spark."""

from __future__ import annotations

import sys as _sys


def _ship_by_value() -> None:
    """Pickle this package's functions by value when Spark sends Python code
    (scorer iterators, chunk-scan steps, barrier state functions) to
    executors, so executors need not have the package installed."""
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle without the API
        pass


_ship_by_value()
