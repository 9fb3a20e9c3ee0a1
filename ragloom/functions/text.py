"""Text expressions shared by the operators: Columns, and the same for the Arrow arrays of a task."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript regular expressions, spelled out
# because Java's own \s covers ASCII only.
SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
BLANK_LINE = rf"\n[{SPACE}]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"


# The same set as characters, for trimming.
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(c: Column) -> Column:
    """Trim white space, Unicode spaces included."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def unquote(c: Column) -> Column:
    """Drop one leading and one trailing quote mark, each on its own."""
    return F.regexp_replace(c, r"""\A["']|["']\z""", "")


def normalise(c: Column) -> Column:
    """Drop one leading byte-order mark; CRLF becomes LF, a lone CR stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\A\x{FEFF}", ""), "\r\n", "\n")


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(c), NOT_WORD), "")


def spaced(c: Column) -> Column:
    """The same words in one text, a blank between them and perhaps around them; tasks take it apart by ``cut_words``."""
    return F.regexp_replace(F.lower(c), NOT_WORD, " ")


def cut_words(texts: pa.Array) -> pa.Array:
    """The list of words of each ``spaced`` text, null for one without any."""
    bare = pc.ascii_trim(texts, " ")
    return pc.split_pattern(pc.if_else(pc.equal(bare, ""), None, bare), " ")


def stem(w: Column) -> Column:
    """Harman's S-stemmer (1991): three plural rules, the first that fits."""
    def ends(*tails: str) -> Column:
        return reduce(or_, [w.endswith(t) for t in tails])

    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
        .when(ends("s") & ~ends("us", "ss"), cut(1))
        .otherwise(w)
    )


def stems_of(found: pa.Array) -> pa.Array:
    """What ``stem`` makes of each word."""
    def ends(*tails: str, but: tuple[str, ...]) -> pa.Array:
        one_of = lambda some: reduce(pc.or_, [pc.ends_with(found, t) for t in some])
        return pc.and_not(one_of(tails), one_of(but))

    cut = lambda n: pc.utf8_slice_codeunits(found, 0, stop=-n)
    rules = [ends("ies", but=("eies", "aies")), ends("es", but=("aes", "ees", "oes")), ends("s", but=("us", "ss"))]
    return pc.case_when(pc.make_struct(*rules), pc.binary_join_element_wise(cut(3), "y", ""), cut(1), cut(1), found)


# Common English function words left out of the lexeme index.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()


def is_stop_word(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def citation_numbers(c: Column) -> Column:
    """Every integer written as ``[n]``, in order; one too wide for a bigint is null."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda d: d.try_cast("bigint")
    )
