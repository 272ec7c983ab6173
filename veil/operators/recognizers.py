"""Pattern recognizers: a pattern finds candidates and a validator keeps those that can be what they look like."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions import checksums
from veil.functions.scan import find_all, let
from veil.operators.spans import none, span


@dataclass(frozen=True)
class Recognizer:
    """``pattern`` may be several, tried one after the other. ``score`` is that of an unchecked candidate; a candidate that passes ``valid`` scores 1.

    Context words, if any stands in the 30 characters before, raise an unchecked score by ``boost``. A text
    without a ``hint``, or without the ``gate`` where there is none, is not searched: they say no more than the pattern does, and are
    the same for many recognizers, so that a text is looked through once for all of them.
    """

    entity_type: str
    pattern: str | tuple[str, ...]
    score: float
    valid: Callable[[Column], Column] | None = None
    languages: tuple[str, ...] = ("hr", "en")
    context: tuple[str, ...] = ()
    boost: float = 0.2
    #: What a text must hold for the pattern to match it: one of some strings, or else a pattern that is cheaper to look for.
    hint: tuple[str, ...] = ()
    gate: str = r"[0-9\P{ASCII}]"


def iban(country: str, account: int, entity_type: str, languages: tuple[str, ...] = ("hr", "en")) -> Recognizer:
    """IBAN of a country: its two letters, two check digits, and ``account`` letters or digits.

    It is written in one piece or in groups of four from its start, of which the last may be shorter.
    """
    group = r"(?:\s?[A-Z0-9]{4})"
    whole, short = divmod(account, 4)
    pieces = [rf"\b{country}\d{{2}}", f"{group}{{{whole}}}", rf"\s?[A-Z0-9]{{{short}}}" if short else "", r"\b"]
    return Recognizer(entity_type, "".join(pieces), 0.5, checksums.mod97, languages, gate=CODED)


#: Gates: some digits in a row, letters before or after digits, a group between colons; letters and digits other than ASCII pass, as the patterns know all of Unicode.
RUN, CODED, LETTERED, SIXTH = r"[0-9\P{ASCII}]{7}", r"[A-Z]{2}[\s\P{ASCII}]?[0-9\P{ASCII}]", r"[0-9\P{ASCII}]{7}[A-W]", r":[0-9A-Fa-f]{1,4}:"
#: Six digits, which all that matches one of LONG holds, and two with a point between.
DIGITS, DOTTED = r"[0-9\P{ASCII}](?:[ -]?[0-9\P{ASCII}]){5}", r"[0-9\P{ASCII}]\.[0-9\P{ASCII}]"
CARD, HEALTH = r"(?:[0-9\P{ASCII}][ -]?){12}[0-9\P{ASCII}]", r"(?:[0-9\P{ASCII}]{3}[ -]?){2}"
LONG = (RUN, LETTERED, CARD, HEALTH)
#: Patterns, scores and context phrases of the national types are fixed values. Order is that of registration and breaks ties.
NATIONAL = (
    Recognizer("HR_OIB", r"\b\d{11}\b", 0.4, checksums.oib, gate=RUN),
    Recognizer("HR_JMBG", r"\b\d{13}\b", 0.4, checksums.jmbg, gate=RUN),
    Recognizer("HR_IBAN", r"\bHR\d{2}(?:\s?\d{4}){4}\s?\d\b", 0.5, checksums.mod97, gate=CODED),
    Recognizer("IE_PPSN", r"\b\d{7}[A-W][AB]?\b", 0.4, checksums.ppsn, gate=LETTERED),
    Recognizer("RO_CNP", r"\b\d{13}\b", 0.4, checksums.cnp, gate=RUN),
    Recognizer("UK_NINO", (r"\b[A-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-D]\b", r"\b[A-Z]{2}\d{6}[A-D]\b"), 0.7, checksums.nino, gate=CODED),
    Recognizer("UK_UTR", r"(?<=\b(?:UTR|utr)\s)\d{10}\b", 0.5, checksums.utr, hint=("UTR", "utr")),
    Recognizer("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.7, checksums.ssn, hint=("-",)),
    Recognizer("US_EIN", r"\b\d{2}-\d{7}\b", 0.6, checksums.ein, context=("EIN", "Employer Identification", "Federal Tax ID", "Tax ID"), hint=("-",)),
    iban("IE", 18, "IE_IBAN"),
    iban("RO", 20, "RO_IBAN"),
    iban("GB", 18, "GB_IBAN"),
)
_HEX = "[0-9A-Fa-f]{1,4}"
#: An IPv6 address that starts with a group: eight groups, or at most seven with two colons among or after them.
IPV6 = (
    rf"\b(?:(?:{_HEX}:){{7}}{_HEX}|" + "|".join(rf"(?:{_HEX}:){{1,{k}}}(?::{_HEX}){{1,{7 - k}}}" for k in range(1, 7)) + rf")\b|\b(?:{_HEX}:){{1,7}}:"
)
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
#: One whose last two groups are written as an IPv4 address, and one that starts with two colons.
IPV6_MIXED = rf"\b(?:(?:{_HEX}:){{6}}|(?:{_HEX}:){{1,5}}:(?:{_HEX}:){{0,4}}){IPV4}"
IPV6_LEADING = rf"(?<![\w:.])::(?:(?:{_HEX}:){{0,5}}{IPV4}|(?:{_HEX}:){{0,6}}{_HEX}\b)"
#: Our own patterns for common types. Numbers of any country are not told apart as a telephone library would.
GENERAL = (
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, hint=("@",)),
    Recognizer("CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", 0.3, checksums.luhn, gate=CARD),
    Recognizer("IP_ADDRESS", IPV6_MIXED, 0.6, hint=("::",), gate=SIXTH),
    Recognizer("IP_ADDRESS", IPV6_LEADING, 0.6, hint=("::",)),
    Recognizer("IP_ADDRESS", IPV4, 0.6, gate=DOTTED),
    Recognizer("IP_ADDRESS", IPV6, 0.6, hint=("::",), gate=SIXTH),
    Recognizer("PHONE_NUMBER", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}\b", 0.5, hint=("+",)),
    Recognizer("SECRET", r"(?i:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}", 0.8, hint=(":", "=")),
    Recognizer("UK_NHS", r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b", 0.5, checksums.nhs, ("en",), gate=HEALTH),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?\b", 0.5, checksums.mod97, ("en",), gate=CODED),
)
REGISTRY = NATIONAL + GENERAL


def registry(language: str | None = None, more: tuple[Recognizer, ...] = (), without: tuple[str, ...] = ()) -> tuple[Recognizer, ...]:
    """Recognizers of a language (of all, if None) and ``more``, less the types in ``without``."""
    return tuple(r for r in REGISTRY + more if (language is None or language in r.languages) and r.entity_type not in without)


def recognize(text: Column, r: Recognizer, ord_: int = 0) -> Column:
    """Spans of one recognizer; candidates that fail its check are dropped."""
    patterns = (r.pattern,) if isinstance(r.pattern, str) else r.pattern
    found = F.concat(*(find_all(text, p) for p in patterns)) if len(patterns) > 1 else find_all(text, patterns[0])
    if r.valid:
        found = F.filter(found, lambda m: r.valid(m["text"]))
    score = F.lit(1.0 if r.valid else r.score)

    def make(m):
        if not r.context:
            return span(r.entity_type, m["start"], m["end"], score, ord_)
        before = F.substring(text, F.greatest(F.lit(1), m["start"] - 29), F.least(F.lit(30), m["start"]))
        near = before.rlike(r"(?iU)\b(?:" + "|".join(r.context) + r")\b")
        return span(r.entity_type, m["start"], m["end"], F.when(near, F.least(F.lit(1.0), score + r.boost)).otherwise(score), ord_)

    return F.transform(found, make)


def possible(text: Column, r: Recognizer, gates: Column | None = None) -> Column:
    """Whether a text may hold what the recognizer finds: has one of its hints, or its gate where no hint is given or found.

    ``gates`` has the gates of all recognizers, if they were looked for before."""
    tests = [F.contains(text, F.lit(h)) for h in r.hint]
    if not r.hint or r.gate != Recognizer.gate:
        tests.append(text.rlike(r.gate) if gates is None else F.try_element_at(gates, F.lit(r.gate)))
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def detect(text: Column, recognizers: tuple[Recognizer, ...] = REGISTRY) -> Column:
    """Spans of all recognizers, each of which looks at texts that may hold one of its own only.

    Each gate is looked for once, and those of long numbers only in texts with DIGITS."""
    needed = [r.gate for r in recognizers if not r.hint or r.gate != Recognizer.gate]
    names = list(dict.fromkeys(needed))

    def found(gates):
        return F.concat(*(F.when(possible(text, r, gates), recognize(text, r, k)).otherwise(none()) for k, r in enumerate(recognizers)))

    def tested(digits):
        return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.when(digits, text.rlike(g)).otherwise(False) if g in LONG else text.rlike(g) for g in names)))

    if not names:
        return F.coalesce(found(None), none()) if recognizers else none()
    return F.coalesce(let(let(text.rlike(DIGITS), tested), found), none())
