"""pressmill: DataFrame operators for scanned-page document extraction data."""

__version__ = "0.1.0"
