"""pairwright — Spark-native curation, selection and scoring of text-rewrite pairs.

Every operator is a function ``DataFrame -> DataFrame`` (use with ``df.transform``)
or a ``Column -> Column`` expression built from ``pyspark.sql.functions``.
"""

__version__ = "0.1.0"
