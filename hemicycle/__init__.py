"""hemicycle: roll-call voting analytics written as Spark DataFrame / SQL jobs.

Sub-packages
------------
sources    table loaders (driver tables mapped onto the voting model), HTML page jobs
functions  Column -> Column helpers: names, dates, URLs, analyzers, phonetics, stemmers
operators  the relational work: ballots and tallies, name resolution, keywords, trees
plans      reusable plan shapes: skew-safe ranking, paging
streaming  keyed upserts from batch or Structured Streaming input, versioned rebuilds
"""

import sys as _sys

# Python functions of this package that run inside tasks (pandas UDFs,
# mapInPandas) are shipped by value, so executors need no installed copy.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass

__all__ = ["session"]
