"""ledgerloom: order and inventory analytics on Spark DataFrames.

Operators live in :mod:`ledgerloom.operators`, file and wire formats in
:mod:`ledgerloom.sources`, column expressions in :mod:`ledgerloom.functions`,
the registered queries in :mod:`ledgerloom.plans`.
"""

__version__ = "0.1.0"


def version() -> str:
    """Version of the package."""
    return __version__
