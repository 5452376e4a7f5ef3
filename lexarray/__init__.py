"""lexarray: retrieval and code analytics over text corpora, expressed as Spark DataFrame plans."""

from lexarray import _ship  # noqa: E402, F401
