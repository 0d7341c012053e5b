"""strandloom: k-mer sets, masked superstrings and their measures as Spark DataFrame plans."""

__version__ = "0.1.0"
