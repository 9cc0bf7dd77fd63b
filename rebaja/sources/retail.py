"""Star-schema tables as retail entities.

Maps the generated order tables to the library's inputs: a line is a POS line,
a part is a child SKU, a region is a store. One brand column (``NORTE``,
``CENTRO``, ``SUR``) is derived from the part's brand number, so every operator
is exercised with several brands in one job.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebaja import schemas
from rebaja.functions.columns import week_start
from rebaja.operators import signals as S
from rebaja.session import materialise

_PREFIXES = ["NI", "AD", "PM", "CAH", "BM", "ZZ"]
_SIZES = ["6,5", "7", "7,5", "8", "8,5", "9", "9,5", "11"]
_BRANDS = ["NORTE", "CENTRO", "SUR"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _brand(q: Column) -> Column:
    return _pick(_BRANDS, q % 3)


def _parent(q: Column) -> Column:
    return F.concat(_pick(_PREFIXES, q % 6), q.cast("string"), F.lit("-"), "p_type")


def _store(region: Column) -> Column:
    return F.when(region == 4, "AB04").otherwise(F.concat(F.lit("200"), region.cast("string")))


class RetailTables:
    """Entity views over one directory of Parquet tables.

    The POS lines, from which most entities derive, are extracted once into a
    table, and so are stock and competitor prices (``extract=False`` leaves them
    views that every reader joins anew).
    """

    def __init__(self, spark: SparkSession, path: str, extract: bool = True):
        self.spark, self.path, self.extract = spark, path.rstrip("/"), extract

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def parts(self) -> DataFrame:
        q = F.regexp_replace("p_brand", "Brand#", "").cast("int")
        return self.table("part").select(
            "p_partkey", "p_type", q.alias("q"), _brand(q).alias("brand"), _parent(q).alias("codigo_padre"),
            (F.col("p_size") % 8).alias("size_ix"),
            F.round(F.col("p_retailprice") * 100).cast("double").alias("list_price"),
        )

    @cached_property
    def products(self) -> DataFrame:
        ix, q = F.col("size_ix"), F.col("q")
        base = self.parts.select("brand", "codigo_padre", "q", "p_type", "size_ix").distinct()
        talla, colour = _pick(_SIZES, ix), _pick(["Negro", "Blanco", "Azul", "Rojo"], q % 4)
        return base.select(
            "brand", F.concat("codigo_padre", F.lit("-"), ix.cast("string")).alias("material"),
            F.concat(F.lit("W "), "p_type", F.lit(" "), q.cast("string"), F.lit(" "), F.upper(colour), F.lit(" N° "), talla)
            .alias("material_descripcion"),
            "codigo_padre", talla.alias("talla"),
            F.when(q % 5 != 0, F.concat(F.lit("78"), F.lpad(q.cast("string"), 4, "0"), ix.cast("string"))).alias("ean11"),
            _pick(_PREFIXES, q % 6).alias("grupo_articulos"),
            _pick(["Nike", "Adidas", "Puma", "Carhartt", "Bamers", "Otra"], q % 6).alias("grupo_articulos_descripcion"),
            F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "SMALL", "MEDIUM"), "Footwear").otherwise("Apparel")
            .alias("primera_jerarquia"),
            F.col("p_type").alias("segunda_jerarquia"),
            F.concat("p_type", F.lit("-"), (q % 2).cast("string")).alias("tercera_jerarquia"),
            F.when(q % 2 == 0, "Hombre").otherwise("Mujer").alias("genero"),
            F.when(q % 7 == 0, "Infantil").otherwise("Adulto").alias("grupo_etario"),
            colour.alias("color1"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return materialise(self.line_view(), "lines") if self.extract else self.line_view()

    def line_view(self) -> DataFrame:
        rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
        orders = self.table("orders").select("o_orderkey", "o_orderdate", rank.cast("byte").alias("_priority"))
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        old = F.col("l_linestatus") == "F"
        cut = F.round(F.col("list_price") * F.col("l_discount") * 6)
        qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        return (
            self.table("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                "brand", F.col("l_orderkey").cast("string").alias("folio"), "l_orderkey", "l_linenumber",
                "l_returnflag", "l_linestatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
                F.when((F.col("l_linenumber") == 7) & old, "NOTA DE CREDITO").otherwise("BOLETA").alias("tipo_documento"),
                F.when(F.col("_priority") == 1, "Retiro en Tienda").otherwise("Despacho")
                .alias("tipo_entrega"),
                F.when((F.col("_priority") == 2) & (F.col("l_linenumber") == 1), "CUPON")
                .alias("codigo_descuento"),
                F.when(old & (F.col("l_linenumber") == 6), "liquidacion")
                .when(old & (F.col("l_linenumber") == 5), "outlet").otherwise("retail").alias("list_category"),
                F.col("l_shipdate").cast("timestamp").alias("fecha"), week_start("l_shipdate").alias("week"),
                _store(F.col("n_regionkey")).alias("centro"),
                F.concat("codigo_padre", F.lit("-"), F.col("size_ix").cast("string")).alias("sku"),
                "codigo_padre", "q", qty.cast("long").alias("cantidad"),
                F.col("list_price").alias("precio_lista"), cut.alias("descuento"),
                (F.col("list_price") - cut).alias("precio_final"),
            )
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return schemas.complete(self.lines, schemas.TRANSACTIONS)

    @cached_property
    def stores(self) -> DataFrame:
        region = self.table("region")
        code = _store(F.col("r_regionkey"))
        return region.select(code.alias("centro"), F.concat(code, F.lit("-"), "r_name").alias("sucursal"),
                             F.col("r_regionkey").cast("string").alias("region"))

    @cached_property
    def stock(self) -> DataFrame:
        """One row per day, store and SKU; written once, as features, sizes and availability each read it."""
        return materialise(self.stock_view(), "stock") if self.extract else self.stock_view()

    def stock_view(self) -> DataFrame:
        hand = (F.col("l_orderkey") % 7) * (F.col("l_linenumber") % 3)
        return (
            self.lines.groupBy("brand", "fecha", F.concat("centro", F.lit("-Tienda")).alias("store_id"), "sku")
            .agg(F.max(hand.cast("long")).alias("stock_on_hand_units"),
                 F.max((F.col("l_orderkey") % 4).cast("long")).alias("stock_in_transit_units"))
            .withColumn("total_stock_position_units",
                        F.col("stock_on_hand_units") + F.col("stock_in_transit_units"))
        )

    @cached_property
    def costs(self) -> DataFrame:
        return (
            self.parts.where(F.col("q") % 10 != 0).groupBy("brand", F.col("codigo_padre").alias("sku"))
            .agg(F.round(F.min("list_price") / 1.19 * (F.lit(0.30) + F.lit(0.05) * (F.max("q") % 8))).alias("cost"))
        )

    @cached_property
    def official_prices(self) -> DataFrame:
        return (self.parts.where(F.col("q") % 3 == 0).groupBy("brand", F.col("codigo_padre").alias("sku"))
                .agg(F.max("list_price").alias("list_price")))

    @cached_property
    def reference_prices(self) -> DataFrame:
        return (self.parts.where(F.col("q") % 4 != 1).groupBy("brand", F.col("codigo_padre").alias("sku"))
                .agg(F.max("list_price").alias("precio_normal")))

    @cached_property
    def rebates(self) -> DataFrame:
        return self.parts.where(F.col("q") % 4 == 0).select(
            "brand", F.col("codigo_padre").alias("parent_sku"),
            F.to_date(F.lit("1998-01-05")).alias("fecha_inicio"), F.to_date(F.lit("2001-12-31")).alias("fecha_termino"),
            (F.lit(1000.0) * (1 + F.col("q") % 3)).alias("aporte_unitario"),
        ).distinct()

    @cached_property
    def po_lines(self) -> DataFrame:
        return self.lines.where("l_linestatus = 'O'").select(
            "brand", F.col("l_orderkey").alias("oc_numero"), "sku", "codigo_padre", "centro",
            F.abs("cantidad").alias("cantidad"), F.date_add("fecha", 14).alias("fecha_entrega"))

    @cached_property
    def receipts(self) -> DataFrame:
        return self.po_lines.where("oc_numero % 3 <> 0").select(
            "brand", "oc_numero", "sku", (F.col("cantidad") - F.col("cantidad") % 5).alias("cantidad_recibida"))

    @cached_property
    def transfers(self) -> DataFrame:
        return self.lines.where("l_returnflag = 'A'").select(
            "brand", "sku", "codigo_padre", "centro", F.col("o_orderdate").alias("fecha_creacion"),
            F.when(F.col("fecha") >= F.col("o_orderdate"), F.col("fecha")).alias("fecha_recepcion"),
            F.abs("cantidad").alias("unidades"))

    @cached_property
    def backorder(self) -> DataFrame:
        return S.backorder_signal(self.po_lines, self.receipts)

    @cached_property
    def replenishment(self) -> DataFrame:
        return S.replenishment_signal(self.transfers)

    @cached_property
    def traffic(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            _store(F.col("user_id") % 5).alias("tienda_id"),
            (F.col("ts").cast("timestamp") - F.expr("INTERVAL 9492 DAYS")).alias("fecha"),
            kind.isin("view", "click", "signup").cast("long").alias("entradas"),
            (kind == "purchase").cast("long").alias("salidas"), F.col("value").alias("tiempo_permanencia_prom"))

    @cached_property
    def weather(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        n = F.count(F.lit(1))
        return (
            self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_regionkey").cast("string").alias("region"), F.col("o_orderdate").cast("date").alias("date"))
            .agg((n % 15 + 12.0).alias("temp_max"), (n % 9 + 2.0).alias("temp_min"),
                 ((n * 7) % 13).cast("double").alias("precipitation"))
        )

    @cached_property
    def competitor_prices(self) -> DataFrame:
        """One competitor per parent and supplier that delivers one of its parts; written once, as its readers name it several times."""
        return materialise(self.competitor_price_view(), "competitor_prices") if self.extract else self.competitor_price_view()

    def competitor_price_view(self) -> DataFrame:
        parents = self.parts.groupBy("brand", "codigo_padre", "q").agg(F.max("list_price").alias("lp"))
        sites = self.table("supplier").select("s_suppkey", "s_name")
        delivered = self.table("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
        # parts meet lines before anything is made distinct, and the parent's names are spelt out after it
        kinds = delivered.join(self.parts.select("p_partkey", "q", "p_type"), "p_partkey").select("q", "p_type", "s_suppkey").distinct()
        offers = kinds.select(_brand(F.col("q")).alias("brand"), _parent(F.col("q")).alias("codigo_padre"), "q", "s_suppkey")
        shift = F.col("q") + F.col("s_suppkey")
        return (
            offers.join(parents, ["brand", "codigo_padre", "q"]).join(sites, "s_suppkey")
            .select(
                "brand", "codigo_padre", F.col("s_name").alias("competitor"),
                F.round(F.col("lp") * (F.lit(0.80) + F.lit(0.05) * (shift % 8))).alias("comp_price"),
                F.col("lp").alias("comp_list_price"), (shift % 4 != 0).alias("comp_in_stock"))
            .withColumn("comp_discount", F.when(F.col("comp_price") < F.col("comp_list_price"), F.round(
                1 - F.col("comp_price") / F.col("comp_list_price"), 3)).otherwise(0.0))
        )

    @cached_property
    def competitor_pages(self) -> DataFrame:
        """One product page per competitor price, with the offer as JSON-LD inside the markup."""
        first = self.parts.groupBy("brand", "codigo_padre").agg(F.min("p_type").alias("kind"), F.min("q").alias("q"))
        offer = F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"),
            F.concat(F.initcap("kind"), F.lit(" "), F.col("q").cast("string"), F.lit(" Mujer")).alias("name"),
            F.struct(F.col("comp_price").cast("long").cast("string").alias("price"),
                     F.when(F.col("comp_in_stock"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock")
                     .alias("availability")).alias("offers"))
        return self.competitor_prices.join(first, ["brand", "codigo_padre"]).select(
            "brand", "codigo_padre", "competitor", F.concat_ws("|", "codigo_padre", "competitor").alias("page_id"),
            F.concat(F.lit("https://"), F.regexp_replace(F.lower("competitor"), "#", ""), F.lit(".example/p/"), "codigo_padre").alias("url"),
            F.concat(F.lit("<html><head><title>x</title><script type=\"application/ld+json\">\n"), F.to_json(offer),
                     F.lit("\n</script></head><body><h1>Oferta</h1></body></html>")).alias("html"))

    @cached_property
    def markdown_contribution(self) -> DataFrame:
        """Supplier contribution per child SKU: a share of the discounts it was sold with."""
        return (
            self.lines.where((F.col("q") % 5 == 0) & (F.col("cantidad") > 0))
            .select("brand", F.col("brand").alias("banner"), "sku",
                    F.floor(F.col("descuento") / 10).cast("double").alias("contribucion_valor"))
        )
