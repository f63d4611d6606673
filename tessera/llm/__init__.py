"""Operators for preparing training data, each one a set of Spark jobs.

Nothing outside this subpackage imports it.  Functions that run inside
Python workers are shipped by value, so executors need no copy of the
package on their import path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
