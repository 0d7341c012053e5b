"""Column functions on letters and k-mers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nucleotide_code(x) -> Column:
    """A, C, G, T in either case as 0 to 3, anything else as 4."""
    at = F.instr(F.lit(LETTERS), F.upper(_col(x)))
    return F.when((F.length(_col(x)) == 1) & (at > 0), at - 1).otherwise(4)


def is_valid(x) -> Column:
    """Whether a text has letters of ACGT only, in either case; null stays null."""
    return F.length(F.translate(_col(x), "ACGTacgt", "")) == 0


def prefix(x, d) -> Column:
    """The first d letters."""
    return F.left(_col(x), F.lit(d) if isinstance(d, int) else d)


def suffix(x, d) -> Column:
    """The last d letters; none for 0."""
    return F.right(_col(x), F.lit(d) if isinstance(d, int) else d)


def without_prefix(x, d: int) -> Column:
    """What follows the first d letters."""
    return F.substr(_col(x), F.lit(d + 1))


def reverse_complement(x) -> Column:
    """The other strand, in upper case."""
    return F.reverse(F.translate(F.upper(_col(x)), "ACGT", "TGCA"))


def canonical(x) -> Column:
    """The smaller of a k-mer and its reverse complement, in upper case."""
    return F.least(F.upper(_col(x)), reverse_complement(x))


def letter_at(x, i: int) -> Column:
    """The letter at position i, from 0."""
    return F.substr(_col(x), F.lit(i + 1), F.lit(1))


def to_number(x) -> Column:
    """A k-mer of up to 31 letters as a number, two bits a letter."""
    return F.conv(F.translate(F.upper(_col(x)), "ACGT", "0123"), 4, 10).cast("bigint")


def from_number(x, k: int) -> Column:
    """The k-mer that a number stands for."""
    return F.translate(F.lpad(F.conv(_col(x), 10, 4), k, "0"), "0123", "ACGT")


def masked(letter, bit) -> Column:
    """Upper case for 1, lower case for 0."""
    return F.when(_col(bit) == 1, F.upper(_col(letter))).otherwise(F.lower(_col(letter)))


def is_upper(letter) -> Column:
    return _col(letter) <= "Z"


def overlap(a, b, k: int) -> Column:
    """The largest d < k such that the last d letters of a are the first d of b."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda d: F.right(_col(a), d) == F.left(_col(b), d))
    return F.array_max(fits)


def first_upper(x, shown: int) -> Column:
    """The first ``shown`` letters, of which the first in upper and the others in lower case."""
    return F.concat(F.upper(F.left(_col(x), F.lit(1))), F.lower(F.substr(_col(x), F.lit(2), F.lit(shown - 1))))


def windows_in(x, k: int) -> Column:
    """How many windows of k a text has."""
    return F.greatest(F.length(_col(x)) - (k - 1), F.lit(0))


def hashed(x) -> Column:
    """A 64-bit hash, to deal k-mers to buckets."""
    return F.xxhash64(_col(x))
