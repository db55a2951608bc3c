"""Operators for preparing training text: ten operators, their queries and their SQL.

Nothing outside this package imports it.  Functions that run on executors are pickled by
value, so executors need none of this package's files.
"""

from pyspark import cloudpickle

import keyspan

cloudpickle.register_pickle_by_value(keyspan)
