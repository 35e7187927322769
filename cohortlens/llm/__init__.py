"""Training-data operators: quality, extraction, licences, near-duplicates, secrets,
byte-level BPE, embeddings, packing, language identification and personal data.

Nothing else in the library imports this subpackage. Its task functions travel to the
executors by value, so a cluster needs numpy, pyarrow and the tokenizer library on its
workers but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
