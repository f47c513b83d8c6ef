"""quillmark: stylometric text-provenance analytics on Spark.

Corpus tables -> variant tables -> feature tables -> evaluation tables,
every step a DataFrame-in / DataFrame-out function.
"""

__version__ = "0.1.0"
