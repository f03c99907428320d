"""Text functions: pure Column expressions, no Python at run time."""

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopulse.constants import STATES
from geopulse.functions.lookup import Lookup, let

# Unicode word characters, spelled out because the \w of the JVM is ASCII only. Most characters are found by the
# range that stands first.
WORD = r"a-z\p{L}\p{N}_"
SPACE = r"\s\x0b\p{Z}\x1c-\x1f\x85"


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_social(col) -> Column:
    """Drop mentions, then hashtags, then links."""
    # A text is searched for a plain mark first, which is cheaper than a pattern.
    def without(mark, pattern):
        return lambda x: F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, "")).otherwise(x)

    out = let(_col(col), without("@", rf"@[{WORD}]+[{SPACE}]*"))
    out = let(out, without("#", rf"#[{WORD}]+[{SPACE}]*"))
    return let(out, without("://", rf"https?://[^{SPACE}]+"))


def normalise_location(col) -> Column:
    """Place string without punctuation, state names abbreviated, runs of blanks collapsed.

    Expects lower-cased input. State names are replaced as substrings, in list order.
    """
    out = F.regexp_replace(_col(col), rf"[^{WORD}{SPACE}]", "")
    for name, short in STATES:
        out = F.replace(out, F.lit(name), F.lit(short))
    return F.regexp_replace(out, " +", " ")


def split_words(col) -> Column:
    return F.split(_col(col), " ")


def split_tokens(col) -> Column:
    """Pipe-joined list as an array."""
    return F.split(_col(col), "[|]")


def join_tags(col) -> Column:
    return F.array_join(_col(col), "|")


def word_subsequences(col, max_words=12) -> Column:
    """Every order-preserving choice of words, shortest first, then by position.

    Grows as 2^n, so it is for inspection and tests; resolving places does not use it.
    More than ``max_words`` words is an error, never a silent cut.
    """

    def choose(words):
        n = F.size(words)
        masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1)

        def pick(mask):
            places = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.call_function("getbit", mask, i) == 1,
            )
            chosen = F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")
            return F.struct(F.size(places).alias("n"), places.alias("at"), chosen.alias("text"))

        ordered = F.array_sort(F.transform(masks, pick))
        too_long = F.raise_error(F.lit(f"more than {max_words} words"))
        return F.when(
            n > max_words, too_long.cast("array<string>")
        ).otherwise(F.transform(ordered, lambda c: c["text"]))

    return let(split_words(col), choose)


def place_name(col) -> Column:
    """Gazetteer name without brackets, dashes between blanks, and dots."""
    out = F.regexp_replace(_col(col), "[()]", "")
    out = F.replace(out, F.lit(" - "), F.lit(" "))
    return F.replace(out, F.lit("."), F.lit(""))


def name_bigrams(col) -> Column:
    """Adjacent word pairs of names of more than two words, else NULL."""

    def pairs(words):
        return F.when(
            F.size(words) > 2,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 2),
                lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)),
            ),
        )

    return let(split_words(col), pairs)


# Tags whose content is not text of the page (fixed values).
HIDDEN_TAGS = ["script", "style", "template", "rt", "rp"]


def _entity_names() -> Lookup:
    """Names that end with a semicolon."""
    return Lookup.of({name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}, "string")


def _legacy_names() -> dict[str, str]:
    """Names that also count without a semicolon, and as the beginning of a longer word."""
    return {name: text for name, text in html.entities.html5.items() if not name.endswith(";")}


def _windows_characters() -> dict[str, str]:
    """What numbers 128 to 159 stand for: the characters of the Windows code page that has them."""
    return {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


REPLACEMENT = "\ufffd"


def _character(digits: Column, base: int) -> Column:
    """The character of a number of any length; what is no character becomes U+FFFD."""
    short = F.regexp_replace(digits, "^0+", "")
    # Seven digits hold every code in either base and fit a number.
    code = F.when(F.length(short) <= 7, F.conv(F.concat(F.lit("0"), short), base, 10).cast("int")).otherwise(-1)
    windows = Lookup.of(_windows_characters(), "string")

    def decoded(n):
        wrong = (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        own = windows.get(n.cast("string"))
        return (
            F.when(wrong, F.lit(REPLACEMENT))
            .when(n.between(128, 159) & own.isNotNull(), own)
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32"))
        )

    return let(code, decoded)


def _decode_references(text: Column) -> Column:
    """Character references decoded once, left to right, by the rules of HTML: a name with its
    semicolon, else the longest old name the text begins with; a number of any length."""
    names, legacy = _entity_names(), _legacy_names()
    old = Lookup.of(legacy, "string")
    longest = max(map(len, legacy))

    def by_prefix(part):
        tries = [
            F.when(old.get(F.substring(part, 1, n)).isNotNull() & (F.length(part) >= n), F.lit(n)) for n in range(longest, 1, -1)
        ]

        def replaced(n):
            return F.when(n.isNull(), F.concat(F.lit("&"), part)).otherwise(
                F.concat(old.get(F.substring(part, F.lit(1), n)), F.regexp_replace(F.substring(part, n + 1, F.length(part)), "^;", ""))
            )

        return let(F.coalesce(*tries), replaced)

    def one(part):
        decimal = F.regexp_extract(part, r"^#([0-9]+)", 1)
        hexa = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+)", 1)
        known = names.get(F.regexp_extract(part, r"^([a-zA-Z][a-zA-Z0-9]*);", 1))
        return (
            F.when(decimal != "", F.concat(_character(decimal, 10), F.regexp_replace(part, r"^#[0-9]+;?", "")))
            .when(hexa != "", F.concat(_character(hexa, 16), F.regexp_replace(part, r"^#[xX][0-9a-fA-F]+;?", "")))
            .when(known.isNotNull(), F.concat(known, F.regexp_replace(part, r"^[a-zA-Z][a-zA-Z0-9]*;", "")))
            .otherwise(by_prefix(part))
        )

    def all_parts(parts):
        rest = F.transform(F.slice(parts, 2, F.size(parts)), one)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), all_parts)).otherwise(text)


# Stands for a removed tag while references are decoded; not allowed in a page itself.
NODE_END = "\x00"


def html_to_text(col) -> Column:
    """Text nodes of a page joined without separator, references decoded.

    A reference without semicolon ends with its text node, so the ends of nodes are kept until the
    references are decoded.
    """
    out = F.regexp_replace(_col(col), r"(?s)<!--.*?-->", NODE_END)
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", NODE_END)
    out = F.regexp_replace(out, r"(?s)<[!/?a-zA-Z][^>]*>", NODE_END)
    return F.replace(_decode_references(out), F.lit(NODE_END), F.lit(""))


CONTRACTIONS = r"(?:n't|'(?:s|m|d|ll|re|ve))"


def tokenise(col) -> Column:
    """Words and single punctuation marks, with English clitics split off ("do", "n't")."""
    text = _col(col)
    after = rf"([^{WORD}]|$)"
    split_clitics = F.regexp_replace(text, rf"(?i)n't{after}", " n't$1")
    split_clitics = F.regexp_replace(split_clitics, rf"(?i)'(s|m|d|ll|re|ve){after}", " '$1$2")
    text = F.when(F.contains(text, F.lit("'")), split_clitics).otherwise(text)
    pattern = rf"({CONTRACTIONS}|[{WORD}]+|[^{WORD}{SPACE}])"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def plain_words(col) -> Column:
    """The words of :func:`words` with blanks between them, more than one at places."""
    return F.regexp_replace(F.lower(_col(col)), rf"[^{WORD} ]+", " ")


def words(col) -> Column:
    """Lower-cased words only."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(rf"([{WORD}]+)"), F.lit(1))
