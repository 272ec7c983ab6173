"""Validators of identifiers: each takes a candidate and says whether its check digits and ranges hold."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths and weights of public check digit schemes. Fixed values.
OIB_LENGTH = 11
JMBG_WEIGHTS = (7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CNP_WEIGHTS = (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)
PPSN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
#: Prefixes never given out, and letters not used first or second. Fixed values of the national scheme.
NINO_PREFIXES = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
NINO_NOT_FIRST, NINO_NOT_SECOND = "DFIQUV", "DFIOQUV"


def digit(value: Column, at: int) -> Column:
    """Digit ``at`` (from 0); null where there is none."""
    return F.try_to_number(F.substring(value, at + 1, 1), F.lit("9")).cast("int")


def weighted(value: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(value, i) * w
    return total


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def oib(value: Column) -> Column:
    """Eleven digits, the last by ISO 7064 MOD 11,10. A fold, as unrolled it would double with each digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(OIB_LENGTH - 1)), lambda i: F.try_to_number(F.substring(value, i, F.lit(1)), F.lit("9")).cast("int"))

    def step(a, d):
        s = (a + d) % 10
        return F.when(s == 0, 20).otherwise(s * 2) % 11

    check = (11 - F.aggregate(digits, F.lit(10), step)) % 10
    return _sure(value.rlike(r"^[0-9]{11}$") & (check == digit(value, OIB_LENGTH - 1)))


def jmbg(value: Column) -> Column:
    check = 11 - weighted(value, JMBG_WEIGHTS) % 11
    return _sure(value.rlike(r"^[0-9]{13}$") & (F.when(check > 9, 0).otherwise(check) == digit(value, 12)))


def cnp(value: Column) -> Column:
    part = lambda a, n: F.substring(value, a, n).try_cast("int")
    ranges = part(1, 1).between(1, 8) & part(4, 2).between(1, 12) & part(6, 2).between(1, 31) & part(8, 2).between(1, 52)
    rest = weighted(value, CNP_WEIGHTS) % 11
    return _sure(value.rlike(r"^[0-9]{13}$") & ranges & (F.when(rest == 10, 1).otherwise(rest) == digit(value, 12)))


def ppsn(value: Column) -> Column:
    """Seven digits and a check letter; a ninth letter counts nine times its place in the alphabet."""
    v = F.upper(value)
    ninth = F.when(F.length(v) == 9, (F.ascii(F.substring(v, 9, 1)) - 64) * 9).otherwise(0)
    rest = (weighted(v, PPSN_WEIGHTS) + ninth) % 23
    letter = F.when(rest == 0, F.lit("W")).otherwise(F.chr((rest + 64).cast("long")))
    return _sure(v.rlike(r"^[0-9]{7}[A-W][A-Z]?$") & (letter == F.substring(v, 8, 1)))


def nino(value: Column) -> Column:
    v = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    banned = F.substring(v, 1, 2).isin(*NINO_PREFIXES) | v.rlike(f"^[{NINO_NOT_FIRST}]") | v.rlike(f"^.[{NINO_NOT_SECOND}]")
    return _sure(v.rlike(r"^[A-Z]{2}[0-9]{6}[A-D]$") & ~banned)


def utr(value: Column) -> Column:
    return _sure(value.rlike(r"^[0-9]{10}$"))


def ssn(value: Column) -> Column:
    area = F.substring(value, 1, 3)
    whole = ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    return _sure(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & whole)


def ein(value: Column) -> Column:
    return _sure(value.rlike(r"^[0-9]{2}-[0-9]{7}$"))


def nhs(value: Column) -> Column:
    v = F.regexp_replace(value, "[ -]", "")
    check = 11 - weighted(v, NHS_WEIGHTS) % 11
    return _sure(v.rlike(r"^[0-9]{10}$") & (F.when(check == 11, 0).otherwise(check) == digit(v, 9)))


def mod97(value: Column) -> Column:
    """ISO 7064 MOD 97-10 of an IBAN: country and check digits go last, letters count from 10."""
    v = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    turned = F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4))
    codes = F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: F.ascii(c))

    def step(a, c):
        number = F.when(c >= 65, c - 55).otherwise(c - 48)
        return (a * F.when(number > 9, 100).otherwise(10) + number) % 97

    return _sure(v.rlike(r"^[A-Z0-9]{5,}$") & (F.aggregate(codes, F.lit(0), step) == 1))


def luhn(value: Column) -> Column:
    return _sure(F.call_function("luhn_check", F.regexp_replace(value, "[ -]", "")))
