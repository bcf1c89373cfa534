"""A Spark-first engine for sequencing reads, fragments, annotation and the clean-up that large corpora of them need."""

__version__ = "0.1.0"
