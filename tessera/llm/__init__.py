"""Operators for preparing language-model training data.

Every module holds one operator with its own general interface; ``registry``
derives the digest queries from them.  Nothing outside this subpackage imports it.
"""

import os

# Small matrices: more threads than one only get into each other's way.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
