"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage. Every operator is a
``DataFrame -> DataFrame`` function: Spark partitions, shuffles and joins the
work, numpy scores Arrow batches inside tasks.
"""
