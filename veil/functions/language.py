"""Language of the text around a span, Croatian or English, by marker words."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.scan import between

#: Marker words. Fixed values.
CROATIAN = (
    "je", "su", "sam", "ću", "nije", "ima", "nema", "moj", "moja", "moje", "mojeg", "mojim", "tvoj", "naš", "naša",
    "ovaj", "ova", "ovo", "taj", "ta", "to", "ali", "nego", "gdje", "kako", "što", "kao", "samo", "već", "još",
    "biti", "bio", "bila", "bilo",
)
ENGLISH = (
    "the", "is", "are", "was", "were", "am", "been", "being", "have", "has", "had", "my", "your", "our", "his", "her",
    "its", "their", "this", "that", "these", "those", "and", "but", "where", "how", "what", "with", "from", "about",
    "please", "thank", "not", "for", "into", "onto", "upon", "after", "before", "during",
)
CROATIAN_MARKER = r"(?iU)\b(?:" + "|".join(CROATIAN) + r")\b|[čšžđć]"
ENGLISH_MARKER = r"(?iU)\b(?:" + "|".join(ENGLISH) + r")\b"
WINDOW = 30


def window_language(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """``en`` if the span and ``window`` characters on either side have more English markers, else ``hr``."""
    around = between(text, F.greatest(F.lit(0), start - window), F.least(F.length(text), end + window))
    croatian, english = (F.regexp_count(around, F.lit(p)) for p in (CROATIAN_MARKER, ENGLISH_MARKER))
    return F.when(english > croatian, F.lit("en")).otherwise(F.lit("hr"))
