"""lexispark: text analytics over document tables, declared with the DataFrame API."""

__version__ = "0.1.0"
