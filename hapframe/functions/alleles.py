"""Recoding of alleles and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hapframe.schema import EOV, MAX_ALLELE, MISSING


def to_bcf(allele: Column, phased: bool = True) -> Column:
    """(allele + 1) << 1 | phase; missing is 0 with its phase bit, end of vector 0x81."""
    code = F.when(allele == MISSING, 0).when(allele == EOV, 128).otherwise((allele + 1) * 2)
    return (code + F.lit(1 if phased else 0)).cast("int")


def from_bcf_biallelic(byte: Column) -> Column:
    """0, 1; 2 = missing, 3 = end of vector, 4 = anything else."""
    code = F.shiftright(byte, 1)
    return F.when(code == 0, 2).when(code == 1, 0).when(code == 2, 1).when(code == 64, 3).otherwise(4)


def from_bcf_general(byte: Column) -> Column:
    """0..13; 14 = missing, 15 = end of vector. Larger alleles fail."""
    code = F.shiftright(byte, 1)
    return F.when(code == 0, MISSING).when(code == 64, EOV).when(code <= MAX_ALLELE + 1, code - 1).otherwise(
        F.raise_error(F.lit("allele beyond 13")).cast("int")
    )


def vcf_symbol(allele: Column) -> Column:
    """The text of an allele; end of vector has none."""
    return F.when(allele == MISSING, ".").when(allele != EOV, allele.cast("string"))


def vcf_allele(symbol: Column) -> Column:
    """0..13; ``.`` is missing. Larger alleles, and what is none, fail."""
    value = symbol.try_cast("int")
    return F.when(symbol.isNull(), F.lit(None).cast("int")).when(symbol == ".", MISSING).when(value <= MAX_ALLELE, value).otherwise(F.raise_error(F.lit(f"allele beyond {MAX_ALLELE}")).cast("int"))
