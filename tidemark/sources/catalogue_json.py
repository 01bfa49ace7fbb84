"""A catalogue of instruments as JSON (`products`): records, rejects and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as vo

# The fields of a product and the labels in its description.
SCHEMA = "struct<products: array<struct<id: string, link: string, name: string, description: string, summary: string, section: string, tip: string, keys: string, character: string, tech: string, price: string, code: string, categories: array<struct<category: string>>>>>"
LABELS = {"underlying_name": "NOMBRE", "underlying_market_raw": "MERCADODEVALORSUBYACENTE", "underlying_symbol": "TICKERENMERCADODEORIGEN", "program_status_raw": "OBSERVACIONESPROGRAMA", "sector": "INDUSTRIAOSECTOR"}
ENTITIES = {"&nbsp;": " ", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# End of fixed values.


def plain(fragment: Column) -> Column:
    """A short piece of markup as text: tags are blanks, common entities decoded."""
    text = F.regexp_replace(F.coalesce(fragment, F.lit("")), r"(?s)<[^>]*>", " ")
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return vo.collapse_whitespace(text)


def description_fields(description: Column) -> Column:
    """Labels (without blanks and accents, upper case) to values from the list items 'label: value'; the first of equal labels."""
    items = F.transform(F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), plain)
    pairs = F.transform(F.filter(items, lambda x: x.contains(":")), lambda x: F.struct(vo.normalise_key(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + F.lit(2), F.length(x))).alias("value")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def products(payloads: DataFrame, *, body: str = "body") -> DataFrame:
    """One row a product with its position; a payload that is no such JSON is an error."""
    parsed = payloads.withColumn("_p", F.from_json(F.col(body), SCHEMA))
    checked = parsed.withColumn("_list", F.when(F.col("_p.products").isNotNull(), F.col("_p.products")).otherwise(F.raise_error(F.lit("the catalogue is no JSON object with products"))))
    return checked.select(F.posexplode("_list").alias("position", "product"))


def records(rows: DataFrame, source: str = "catalogue") -> DataFrame:
    """Products as records, with `reason` for rejects (missing_symbol) and `warnings`."""
    p = lambda c: F.col(f"product.{c}")
    filled = lambda c: F.nullif(vo.collapse_whitespace(c), F.lit(""))
    rows = rows.withColumn("_f", description_fields(p("description")))
    label = lambda k: F.nullif(F.try_element_at(F.col("_f"), F.lit(LABELS[k])), F.lit(""))
    symbol, ratio, market = vo.normalise_symbol(p("name")), vo.parse_ratio(p("character")), label("underlying_market_raw")
    kind = vo.section_type(p("section"))
    warnings = F.array(
        F.when(ratio.isNull() & filled(p("character")).isNotNull(), "ambiguous_ratio"),
        F.when(market.isNotNull() & ~vo.is_missing_market(market) & ~vo.is_known_market(market), "unknown_market"),
        F.when(kind == "UNKNOWN", "unknown_section"),
    )
    return rows.select(
        F.lit(source).alias("provider"), F.col("position").alias("pos"), symbol.alias("symbol"), filled(p("link")).alias("source_ref"),
        F.nullif(plain(F.coalesce(p("summary"), p("description"))), F.lit("")).alias("name"), kind.alias("instrument_type"),
        vo.normalise_symbol(label("underlying_symbol")).alias("underlying_symbol"), label("underlying_name").alias("underlying_name"), market.alias("underlying_market_raw"),
        vo.clean_isin(p("tech")).alias("underlying_isin"), ratio.alias("ratio"), vo.clean_isin(p("tip")).alias("isin"),
        vo.normalise_program_status(label("program_status_raw")).alias("program_status"), label("program_status_raw").alias("program_status_raw"),
        F.create_map(F.lit("sector"), label("sector"), F.lit("share_class"), filled(p("keys")), F.lit("country"), F.try_element_at("product.categories", F.lit(1))["category"], F.lit("ratio_raw"), filled(p("character"))).alias("extra"),
        F.when(symbol.isNull(), "missing_symbol").alias("reason"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )
