"""Document-corpus analytics on Spark: every public function takes and returns DataFrames."""

__version__ = "0.1.0"
