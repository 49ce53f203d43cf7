"""Form extraction on Spark: from recognised symbols to trustworthy rows.

Every public operator takes and returns DataFrames. Some measure the size of a
side or write a shared intermediate table first; none pulls page data to the
driver.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers need not have this package installed: the few functions that
# run in them travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
