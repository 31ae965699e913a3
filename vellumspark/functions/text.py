"""White space and Unicode form of document text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space. Fixed: what counts as a blank decides every text that comes out.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Runs that aren't one space already.
_RUN = re.compile(f"[{WHITE.replace(' ', '')}][{WHITE}]*| [{WHITE}]+")
JAVA_WHITE = r"[\t-\r \x85\xA0  -     　]+"


def collapse(text: str) -> str:
    """Every run of white space as one space, at the ends too."""
    return _RUN.sub(" ", text)


def trim(text: str) -> str:
    return text.strip(WHITE)


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def collapse_column(text: Column) -> Column:
    return F.regexp_replace(text, JAVA_WHITE, " ")


def nfc_column(text: Column) -> Column:
    """NFC by the ICU that Spark brings; texts of ASCII alone skip it."""
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7F]"), done).otherwise(text)
