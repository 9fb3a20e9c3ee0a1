"""Web-page expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.text import SPACE, strip

# The cleaning steps, in the order they must run.
CLEANING_STEPS = (
    (r"(?is)<script.*?</script>", " "),
    (r"(?is)<style.*?</style>", " "),
    (r"(?is)<noscript.*?</noscript>", " "),
    (r"(?s)<!--.*?-->", " "),
    (rf"(?i)<br[{SPACE}]*/?>", "\n"),
    (r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol)>", "\n"),
    (r"<[^>]+>", " "),
)
# Entities and their characters; the ampersand is decoded before the angle brackets.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'),
)
SQUEEZE_STEPS = ((r"[ \t]+", " "), (rf"\n[{SPACE}]*\n[{SPACE}]*\n+", "\n\n"))


def html_to_text(html: Column, max_chars: int | None = None) -> Column:
    """Readable text of a page with rough line structure, cut to ``max_chars``."""
    text = html
    for pattern, into in CLEANING_STEPS:
        text = F.regexp_replace(text, pattern, into)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    for pattern, into in SQUEEZE_STEPS:
        text = F.regexp_replace(text, pattern, into)
    text = strip(text)
    return text if max_chars is None else F.substring(text, 1, max_chars)


# What login and bot-check pages say.
WALL_PHRASES = (
    "sign in to continue", "log in to continue", "verify you are human", "are you a robot",
    "enable javascript", "please enable js", "access denied", "captcha",
)


def is_wall(text: Column, empty_below: int = 200, short_below: int = 600) -> Column:
    """Near-empty text, or short text with a login or bot-check phrase."""
    phrase = F.regexp_like(F.lower(text), F.lit("|".join(WALL_PHRASES)))
    return (F.length(text) < empty_below) | ((F.length(text) < short_below) & phrase)
