"""Operators for building training corpora, one module per operator.

Nothing outside this subpackage imports it.  Functions that run inside
Python tasks are shipped by value, so executors need no copy of the
package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
