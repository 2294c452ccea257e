"""lodeseek: hybrid document retrieval and its evaluation, as Spark DataFrame plans."""

__version__ = "0.1.0"
