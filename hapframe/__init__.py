"""hapframe: a PySpark engine for genotype and haplotype matrices."""

__version__ = "0.1.0"
