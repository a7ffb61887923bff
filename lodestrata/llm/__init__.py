"""Training-data operators: tokenizers, archives, scoring, packing, de-duplication and document filters.

Nothing outside this package imports it.  Functions that run on executors are pickled by value, so executors need the
libraries these modules use but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
