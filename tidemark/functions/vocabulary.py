"""Text rules for instruments: white space, accents, venues, programme status, ratios, symbols, ISINs (Column to Column)."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of venues, marks of programme status, types of catalogue sections and tables.
MARKET_ALIASES = {
    "nyse": "NYSE", "new york stock exchange": "NYSE",
    "nyseamerican": "NYSE_AMERICAN", "nyse american": "NYSE_AMERICAN", "nyse amex": "NYSE_AMERICAN", "amex": "NYSE_AMERICAN",
    "nyse arca": "NYSE_ARCA", "nysearca": "NYSE_ARCA", "arca": "NYSE_ARCA",
    "nasdaq gs": "NASDAQ_GS", "nasdaqgs": "NASDAQ_GS", "nasdaq global select": "NASDAQ_GS",
    "nasdaq gm": "NASDAQ_GM", "nasdaqgm": "NASDAQ_GM", "nasdaq global market": "NASDAQ_GM",
    "nasdaq cm": "NASDAQ_CM", "nasdaqcm": "NASDAQ_CM", "nasdaq capital market": "NASDAQ_CM",
    "cboe bzx": "CBOE_BZX", "cbobzx": "CBOE_BZX", "bzx": "CBOE_BZX",
    "otc": "OTC", "otc us": "OTC", "otcus": "OTC", "otc markets": "OTC",
    "b3": "B3", "b3 sa": "B3",
    "xetra": "XETRA", "deutsche boerse": "XETRA",
    "lse": "LSE", "london stock exchange": "LSE", "london": "LSE",
}
MISSING_MARKETS = ("", "none", "n/a", "na", "-", "null")
INACTIVE_MARKERS, ACTIVE_MARKER = ("inhabilit", "inhablit"), "habilitado"
SECTION_TYPES = {"CEDEARSHARES": "STOCK", "CEDEARETF": "ETF", "CEDEARCORPORATE": "OTHER"}
TABLE_KINDS = {"CEDEARDEETF": "ETF", "CEDEARDEACCIONES": "STOCK", "CEDEARDEACCION": "STOCK"}
MARKET_SUFFIXES = {"NYSE": "", "NYSE_AMERICAN": "", "NYSE_ARCA": "", "NASDAQ_GS": "", "NASDAQ_GM": "", "NASDAQ_CM": "", "CBOE_BZX": "", "OTC": "", "B3": ".SA", "XETRA": ".DE", "LSE": ".L"}
MARKET_ZONES = {
    "NYSE": "America/New_York", "NYSE_AMERICAN": "America/New_York", "NYSE_ARCA": "America/New_York",
    "NASDAQ_GS": "America/New_York", "NASDAQ_GM": "America/New_York", "NASDAQ_CM": "America/New_York",
    "CBOE_BZX": "America/New_York", "OTC": "America/New_York", "B3": "America/Sao_Paulo", "XETRA": "Europe/Berlin",
    "LSE": "Europe/London", "UNKNOWN": "UTC",
}
ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
# End of fixed values.


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The value of a small constant map; null where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " ", " "), r"[ \t\n\x0B\f\r]+", " "))


#: Hangul syllables are composed by rule: leading consonant, vowel, trailing consonant or none.
HANGUL, LEADS, VOWELS, TAILS = range(0xAC00, 0xD7A4), 0x1100, 0x1161, 0x11A8
#: The last code point that has a decomposition lies before this one.
DECOMPOSED_UP_TO = 0x2FA20


@functools.cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition (NFKD) without combining marks does to single characters, from the standard library's tables.

    Two strings for `translate` (characters that become one other; combining marks, which go, come last in the first) and the
    characters that become several.
    """
    one, gone, many = {}, [], {}
    for code in range(0x80, DECOMPOSED_UP_TO):
        c = chr(code)
        if code in HANGUL or not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not left:
            gone.append(c)
        elif len(left) > 1:
            many[c] = left
        elif left != c:
            one[c] = left
    return "".join([*one, *gone]), "".join(one.values()), many


def char_class(codes: list[int]) -> str:
    """A pattern for any of these code points (ascending), runs as ranges."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks: accents go, ligatures, fractions and syllables are taken apart."""
    single, plain, many = decompositions()
    several = char_class(sorted([*map(ord, many), *HANGUL]))
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    jamo = lambda first, n: F.lit("".join(chr(first + i) for i in range(n)))

    def apart(x: Column) -> Column:
        at = F.ascii(x) - HANGUL.start
        tail = at % 28
        syllable = F.concat(F.substring(jamo(LEADS, 19), F.floor(at / 588).cast("int") + 1, 1), F.substring(jamo(VOWELS, 21), F.floor(at % 588 / 28).cast("int") + 1, 1), F.when(tail > 0, F.substring(jamo(TAILS, 27), tail, 1)).otherwise(""))
        return F.when(F.ascii(x).between(HANGUL.start, HANGUL[-1]), syllable).when(x.rlike(several), F.try_element_at(table, x)).otherwise(x)

    text = F.translate(c, single, plain)
    return F.when(text.rlike(several), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), apart), "")).otherwise(text)


def normalise_key(c: Column) -> Column:
    """White space and accents gone, upper case: for headers and labels."""
    return F.upper(F.regexp_replace(strip_accents(collapse_whitespace(c)), r"\s", ""))


def normalise_market(c: Column) -> Column:
    return F.coalesce(lookup(MARKET_ALIASES, F.lower(collapse_whitespace(c))), F.lit("UNKNOWN"))


def is_known_market(c: Column) -> Column:
    return normalise_market(c) != "UNKNOWN"


def is_missing_market(c: Column) -> Column:
    return F.lower(collapse_whitespace(c)).isin(*MISSING_MARKETS)


def normalise_program_status(c: Column) -> Column:
    """The inactive marks come first, as each holds most of the active one."""
    text = F.lower(strip_accents(collapse_whitespace(c)))
    inactive = text.contains(INACTIVE_MARKERS[0]) | text.contains(INACTIVE_MARKERS[1])
    return F.when(inactive, "INACTIVE").when(text.contains(ACTIVE_MARKER), "ACTIVE").otherwise("UNKNOWN")


def parse_ratio(c: Column) -> Column:
    """'N:D' as decimal(20,10), half up; anything else, or a zero D, is null."""
    text, pattern = collapse_whitespace(c), r"^(\d+(?:[.,]\d+)?)\s*:\s*(\d+(?:[.,]\d+)?)$"
    part = lambda i: F.translate(F.regexp_extract(text, pattern, i), ",", ".").try_cast("decimal(18,8)")
    return F.when(text.rlike(pattern) & (part(2) != 0), F.round(F.try_divide(part(1), part(2)), 10).cast("decimal(20,10)"))


def format_ratio(c: Column) -> Column:
    """Whole ratios as 'N:1', others as '1:' and the reciprocal without trailing zeros."""
    ratio = c.cast("decimal(20,10)")
    reciprocal = F.try_divide(F.lit(1).cast("decimal(20,10)"), ratio).cast("decimal(20,10)").cast("string")
    return F.when(ratio == F.floor(ratio), F.concat(F.floor(ratio).cast("string"), F.lit(":1"))).when(ratio.isNotNull(), F.concat(F.lit("1:"), F.regexp_replace(F.regexp_replace(reciprocal, "0+$", ""), r"\.$", "")))


def normalise_symbol(c: Column) -> Column:
    return F.nullif(F.upper(collapse_whitespace(c)), F.lit(""))


def clean_isin(c: Column) -> Column:
    text = F.replace(F.upper(collapse_whitespace(c)), F.lit(" "), F.lit(""))
    return F.when(text.rlike(ISIN), text)


def section_type(c: Column) -> Column:
    return F.coalesce(lookup(SECTION_TYPES, normalise_key(c)), F.lit("UNKNOWN"))


def market_zone(market: Column) -> Column:
    return lookup(MARKET_ZONES, market)


def vendor_symbol(symbol: Column, market: Column) -> Column:
    """The data vendor's ticker; null for a venue that it cannot be routed to."""
    return F.concat(symbol, lookup(MARKET_SUFFIXES, market))


def chart_url(endpoint: str, symbol: Column, start: Column, end: Column) -> Column:
    """Address of a daily chart; both dates are included."""
    seconds = lambda d: (F.unix_date(d) * 86400).cast("long")
    return F.concat(F.lit(endpoint + "/"), symbol, F.lit("?period1="), seconds(start).cast("string"), F.lit("&period2="), (seconds(end) + 86400).cast("string"), F.lit("&interval=1d&includeAdjustedClose=true&events=history"))
