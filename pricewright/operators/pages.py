"""Structured data of pages: JSON-LD parsed to VARIANT and walked to its product nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.catalog import Catalog, sql
from pricewright.functions import text as T
from pricewright.session import materialize

# The members that may hold further nodes, those of a gtin in the order they are tried, and of a price.
HOLDERS = ["@graph", "itemListElement", "mainEntity", "offers", "hasPart"]
PRICE_HOLDERS = ["@graph", "offers"]
GTINS = ["gtin", "gtin13", "gtin12", "gtin14", "gtin8"]
PRICES = ["price", "lowPrice", "highPrice"]
CURRENCIES = ["priceCurrency", "currency"]

BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def _at(node: Column, *names: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, "$" + "".join(f"['{name}']" for name in names), kind)


def _list(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def _text(node: Column, name: str) -> Column:
    """A member as text: a string or number itself, of an object its name or value; null for empty ones."""
    inner = F.coalesce(_at(node, name, "name", kind="string"), _at(node, name, "@value", kind="string"))
    held = F.when(_is_object(_at(node, name)), inner).when(_list(_at(node, name)).isNull(), _at(node, name, kind="string"))
    return F.nullif(F.trim(held), F.lit(""))


def walk(pages: DataFrame, holders: list[str]) -> DataFrame:
    """(page, path, node): every object reached from the JSON-LD of ``pages`` (page, html) by lists and ``holders``.

    ``path`` orders nodes as they stand in the page, outer ones first. Blocks
    that are no JSON are left out. There are as many rounds as nodes are deep;
    each reads only the nodes that the last one found.
    """
    blocks = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("i", "text"))
    rows = blocks.select("page", F.array("i").alias("path"), F.try_parse_json(F.trim("text")).alias("node")).where("node is not null")
    found = []
    while True:
        rows = materialize(rows, "nodes")
        if rows.isEmpty():
            break
        found.append(rows.where(_is_object(F.col("node"))))
        items = F.transform(_list(F.col("node")), lambda x, i: F.struct(i.alias("i"), x.alias("node")))
        members = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), _at(F.col("node"), name).alias("node")) for i, name in enumerate(holders))), lambda x: x["node"].isNotNull())
        inner = rows.select("page", "path", F.explode(F.coalesce(items, members)).alias("x"))
        rows = inner.select("page", F.concat("path", F.array("x.i")).alias("path"), F.col("x.node").alias("node"))
    nodes = found[0] if found else rows
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def is_product(node: Column) -> Column:
    """Its type is Product, or a list with a type of that name in it."""
    listed = F.try_variant_get(node, "$['@type']", "array<string>")
    return F.coalesce(F.exists(listed, lambda t: t.rlike("(?i)product")), _at(node, "@type", kind="string") == "Product", F.lit(False))


def _own(node: Column) -> tuple[Column, Column]:
    """gtin and mpn of a node itself, else of the first of its offers that has one."""
    offers = F.coalesce(_list(_at(node, "offers")), F.when(_at(node, "offers").isNotNull(), F.array(_at(node, "offers"))))

    def first(pick) -> Column:
        return F.get(F.filter(F.transform(offers, pick), lambda x: x.isNotNull()), F.lit(0))

    gtin = lambda n: F.coalesce(*(_text(n, name) for name in GTINS))
    mpn = lambda n: _text(n, "mpn")
    return F.coalesce(gtin(node), first(gtin)), F.coalesce(mpn(node), first(mpn))


def identifiers(pages: DataFrame) -> DataFrame:
    """(page, gtin, mpn, brand) of the pages (page, html) with product nodes, by the first node that has a gtin or mpn, else the first.

    A node without either takes those of its first variant that has one. Members
    of other nodes, such as related products, don't count. A gtin has 8, 12, 13
    or 14 digits, or is null.
    """
    nodes = walk(pages, HOLDERS).where(is_product(F.col("node")))
    gtin, mpn = _own(F.col("node"))
    variants = F.coalesce(_list(_at(F.col("node"), "hasVariant")), F.when(_at(F.col("node"), "hasVariant").isNotNull(), F.array(_at(F.col("node"), "hasVariant"))))

    def both(x: Column) -> Column:
        own = _own(x)
        return F.struct(T.valid_gtin(own[0]).alias("gtin"), own[1].alias("mpn"))

    variant = F.get(F.filter(F.transform(variants, both), lambda x: x["gtin"].isNotNull() | x["mpn"].isNotNull()), F.lit(0))
    rows = nodes.select("page", "path", gtin.alias("gtin"), mpn.alias("mpn"), _text(F.col("node"), "brand").alias("brand"), variant.alias("variant"))
    bare = F.col("gtin").isNull() & F.col("mpn").isNull()
    rows = rows.withColumns({"g": F.when(bare, F.col("variant.gtin")).otherwise(T.valid_gtin(F.col("gtin"))), "m": F.when(bare, F.col("variant.mpn")).otherwise(F.col("mpn"))})
    best = F.min_by(F.struct(F.col("g").alias("gtin"), F.col("m").alias("mpn"), "brand"), F.struct(F.col("g").isNull() & F.col("m").isNull(), "path"))
    return rows.groupBy("page").agg(best.alias("b")).select("page", "b.*")


def prices(pages: DataFrame) -> DataFrame:
    """(page, price, currency) of the first node of each page with a price above 0: its own, the lowest or the highest of a range."""
    nodes = walk(pages, PRICE_HOLDERS)
    raw = F.coalesce(*(_at(F.col("node"), name, kind="string") for name in PRICES))
    price = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    currency = F.coalesce(*(_at(F.col("node"), name, kind="string") for name in CURRENCIES))
    rows = nodes.select("page", "path", price.alias("price"), currency.alias("currency")).where("price > 0")
    return rows.groupBy("page").agg(F.min_by(F.struct("price", "currency"), "path").alias("b")).select("page", "b.*")


#: Product pages as shops write them, in the SQL that both engines read.
PAGE = """'<html><script type="application/ld+json">' || CASE size % 8
  WHEN 0 THEN '{"@type":"Product","gtin13": ' || (1000000000000 + product_id::BIGINT) || ', "brand": {"@type": "Brand", "name": "' || brand || '"}, "isRelatedTo": {"@type":"Product","gtin":"99999999"}, "offers": {"price": "' || size || '.50", "priceCurrency": "USD"}}'
  WHEN 1 THEN '{"@graph": [{"@type": "WebSite", "gtin": "88888888"}, {"@type": ["Thing", "Product"], "offers": [{"price": 0}, {"gtin8": "' || lpad(product_id, 8, '0') || '", "mpn": "M' || size || '", "lowPrice": ' || size || '}]}]}'
  WHEN 2 THEN '{"@type":"Product","brand": "' || brand || '", "hasVariant": [{"sku": "1"}, {"gtin": "12-34"}, {"gtin12": "' || lpad(product_id, 12, '0') || '"}]}'
  WHEN 3 THEN '[{"@type":"Thing","offers":{"@type":"AggregateOffer","highPrice":"1,' || lpad(size::VARCHAR, 3, '0') || '.00","currency":"EUR"}}, {"@type":"ItemList","itemListElement":[{"@type":"Product","name":"x"},{"@type":"Product","mpn":" N' || size || ' ","offers":{"price":5}}]}]'
  WHEN 4 THEN '{"@type":"Product", broken</script><script type=''application/ld+json''>{"@type":"Product","gtin":" 0-' || lpad(product_id, 7, '0') || ' ","price":"free","offers":{"price":"' || size || '"}}'
  WHEN 5 THEN '{"@type":"Offer","gtin":"77777777","price":' || size || '}'
  WHEN 6 THEN '{"@type":"WebPage","mainEntity":{"@type":"Product","gtin":"123","mpn":null,"brand":{"@value":"' || brand || '"}}}'
  ELSE '"only text"' END || '</script></html>'"""


def product_pages(c: Catalog) -> DataFrame:
    text = PAGE.replace("::BIGINT", "").replace("size::VARCHAR", "CAST(size AS STRING)").replace("''application/ld+json''", "\\'application/ld+json\\'")
    return c.products.select(F.col("product_id").alias("page"), F.expr(text.replace("product_id)", "CAST(product_id AS BIGINT))")).alias("html"))


def q_jsonld_products(spark, sf_dir):
    return identifiers(product_pages(Catalog(spark, sf_dir))).withColumnRenamed("page", "product_id")


def q_jsonld_prices(spark, sf_dir):
    return prices(product_pages(Catalog(spark, sf_dir))).withColumnRenamed("page", "product_id")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "jsonld_products": sql(
        """SELECT product_id, CASE size % 8 WHEN 0 THEN (1000000000000 + product_id::BIGINT)::VARCHAR WHEN 1 THEN lpad(product_id, 8, '0') WHEN 2 THEN lpad(product_id, 12, '0') WHEN 4 THEN '0' || lpad(product_id, 7, '0') END AS gtin,
        CASE size % 8 WHEN 1 THEN 'M' || size WHEN 3 THEN 'N' || size END AS mpn, CASE WHEN size % 8 IN (0, 2, 6) THEN brand END AS brand FROM products WHERE size % 8 NOT IN (5, 7)"""
    ),
    "jsonld_prices": sql(
        """SELECT product_id, CASE size % 8 WHEN 0 THEN size + 0.5 WHEN 3 THEN 1000 + size ELSE size END::DOUBLE AS price, CASE size % 8 WHEN 0 THEN 'USD' WHEN 3 THEN 'EUR' END AS currency
        FROM products WHERE size % 8 IN (0, 1, 3, 4, 5) AND size > 0"""
    ),
}
