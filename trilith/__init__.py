"""trilith: Spark-native profiling, cleaning, text-feature, clustering and
classification operators for labelled item tables.

Every operator is a plain function over ``pyspark.sql.DataFrame``.  Fitted
parameters are small (one row, or one row per group/term) and are kept
separate from the apply step, so a fit on the training split can be applied
to any other split, batch or stream.
"""

__version__ = "0.1.0"
