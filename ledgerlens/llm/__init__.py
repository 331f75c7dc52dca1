"""Training-data operators: search, language id, archives, tokens, de-duplication, licences, privacy, mixing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` registers one whole-table
query per operator and its DuckDB SQL where SQL can express it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code, so workers need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
