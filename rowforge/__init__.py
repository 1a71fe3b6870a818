"""rowforge: Spark-native record validation, record serde and analytics expressions."""

__version__ = "0.1.0"
