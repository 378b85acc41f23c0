"""lexweave: phrase mining, thesaurus building and term statistics on Spark.

Subpackages: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (DataFrame to DataFrame), ``plans`` (registered
queries and their SQL), ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"


def _send_code_by_value() -> None:
    """Functions of this package travel to Python workers with their code, so executors need no copy of it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_send_code_by_value()
