"""Graph-memory and hybrid-retrieval analytics as declarative Spark plans.

Every operator is a function ``DataFrame... -> DataFrame``; parameters that
depend on the clock (``now``, ``as_of``) are explicit arguments.
"""

__version__ = "0.1.0"
