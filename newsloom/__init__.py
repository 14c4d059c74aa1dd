"""newsloom: a Spark-native engine for building, cleaning and evaluating news-text corpora.

Every operator is a lazy ``DataFrame -> DataFrame`` transform built from Catalyst
expressions, joins, windows and aggregates.  Python workers are used only where no
built-in expression exists (byte-pair merging over *distinct* words, the packing
of short sequences, MLlib training).
"""

from newsloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
