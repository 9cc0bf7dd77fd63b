"""Source signals: costs, prices, rebates, price lists, orders and transfers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebaja.functions import columns as X


def brand_rows(df: DataFrame, skus: DataFrame, key: str = "sku") -> DataFrame:
    """Rows whose SKU belongs to the brand's catalogue (semi join)."""
    return df.join(skus.select("brand", F.col("sku").alias(key)), ["brand", key], "left_semi")


def latest_costs(costs: DataFrame, children: DataFrame, as_of: Column, lookback_days: int = 90) -> DataFrame:
    """Parent cost: latest cost per child and centre in the window, averaged.

    ``costs``: brand, sku (child), centro, fecha, costo. ``children``: brand,
    sku, codigo_padre.
    """
    recent = costs.where((F.col("costo") > 0) & (F.col("fecha").cast("date") >= F.date_sub(as_of, lookback_days)))
    latest = recent.groupBy("brand", "sku", "centro").agg(F.max_by("costo", F.struct("fecha", "costo")).alias("costo"))
    catalogue = children.groupBy("brand", "codigo_padre").agg(F.count(F.lit(1)).alias("n_children_total"))
    return (
        latest.join(children, ["brand", "sku"]).groupBy("brand", "codigo_padre")
        .agg(F.round(F.avg("costo")).cast("long").alias("cost"),
             F.countDistinct("sku").alias("n_children_with_cost"))
        .join(catalogue, ["brand", "codigo_padre"])
        .withColumnRenamed("codigo_padre", "sku")
    )


def fallback_costs(legacy: DataFrame) -> DataFrame:
    """Legacy costs; amounts under 500 are in thousands of pesos."""
    return (
        legacy.where("cost > 0").withColumn("cost", F.when(F.col("cost") < 500, F.col("cost") * 1000).otherwise(F.col("cost")))
        .groupBy("brand", "sku").agg(F.min("cost").alias("cost"))
    )


def combine_costs(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary costs, and secondary ones for parents the primary lacks."""
    first = primary.groupBy("brand", "sku").agg(F.max("cost").cast("double").alias("cost"))
    rest = secondary.join(first, ["brand", "sku"], "left_anti").select("brand", "sku", F.col("cost").cast("double"))
    return first.unionByName(rest)


def valid_prices(prices: DataFrame, as_of: Column) -> DataFrame:
    """Highest list price valid on a day; an open end stays valid."""
    return (
        prices.where((F.col("precio_normal") > 0) & (F.col("fecha_inicio_validez") <= as_of)
                     & (F.col("fecha_fin_validez").isNull() | (F.col("fecha_fin_validez") > as_of)))
        .groupBy("brand", "sku").agg(F.max("precio_normal").alias("list_price"))
    )


def active_rebates(rebates: DataFrame, weeks: DataFrame) -> DataFrame:
    """Highest supplier contribution per parent among events that cover the week.

    ``weeks``: the (brand, week) pairs asked for, at most the weeks of the
    calendar for each brand. An event is exploded to the Mondays it covers, so
    the join is on equal weeks, not on a range.
    """
    first = F.trunc(F.date_add("fecha_inicio", 6), "week")
    mondays = F.when(first <= F.col("fecha_termino"), F.sequence(first, F.col("fecha_termino"), F.expr("INTERVAL 7 DAYS")))
    return (
        rebates.withColumn("week", F.explode(mondays)).join(F.broadcast(weeks.select("brand", "week")), ["brand", "week"])
        .groupBy("brand", "parent_sku", "week").agg(F.max("aporte_unitario").alias("rebate"))
    )


def price_list_names(sales: DataFrame, invoices: DataFrame, lists: DataFrame) -> DataFrame:
    """(folio, centro) to price-list name and category."""
    return (
        sales.where("folio_sii is not null").join(invoices, "doc_facturacion").join(lists, "lista_precio_id")
        .select("brand", X.folio_number("folio_sii").alias("folio"), F.col("tienda_codigo_sap").alias("centro"),
                F.col("descripcion").alias("list_name")).distinct()
        .withColumn("list_category", X.classify_price_list("list_name"))
    )


def enrich_price_list(txn: DataFrame, names: DataFrame) -> DataFrame:
    """Attach list name and category; one list per (folio, centro) so no line is repeated."""
    one = names.groupBy("brand", "folio", "centro").agg(
        F.min(F.struct("list_name", "list_category")).alias("_list"))
    base = txn.drop("list_name", "list_category")
    return base.join(one, ["brand", "folio", "centro"], "left").select("*", "_list.*").drop("_list")


def backorder_signal(po_lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """Open order units per (sku, centro): receipts are added up before the join.

    Ordered and received units are summed apart: what an order line holds is
    added up where it lies, and only its key and place meet the receipts.
    """
    place = ["brand", F.col("codigo_padre").alias("cod_padre"), "sku", "centro"]
    received = receipts.groupBy("brand", "oc_numero", "sku").agg(F.sum("cantidad_recibida").alias("_received")).where("_received is not null")
    ordered = po_lines.groupBy(*place).agg(
        F.sum("cantidad").alias("_open"), F.min("fecha_entrega").alias("earliest_delivery"), F.count(F.lit(1)).alias("n_open_pos"))
    arrived = (
        po_lines.where("cantidad is not null").select("oc_numero", *place).join(received, ["brand", "oc_numero", "sku"])
        .groupBy("brand", "cod_padre", "sku", "centro").agg((-F.sum("_received")).alias("_open"))
    )
    return (
        ordered.unionByName(arrived, allowMissingColumns=True).groupBy("brand", "cod_padre", "sku", "centro")
        .agg(F.sum("_open").cast("double").alias("open_qty"), F.min("earliest_delivery").alias("earliest_delivery"),
             F.sum("n_open_pos").alias("n_open_pos"))
        .where("open_qty > 0")
    )


def replenishment_signal(transfers: DataFrame) -> DataFrame:
    """Units on the way and received, with mean transit days, per (sku, centro)."""
    done = F.col("fecha_recepcion").isNotNull()
    days = F.datediff("fecha_recepcion", "fecha_creacion")
    return (
        transfers.groupBy("brand", F.col("codigo_padre").alias("cod_padre"), "sku", "centro")
        .agg(F.sum(F.when(done, 0).otherwise(F.col("unidades"))).cast("double").alias("units_in_transit"),
             F.sum(F.when(done, F.col("unidades")).otherwise(0)).cast("double").alias("units_received_window"),
             F.avg(F.when(done, days)).alias("avg_transit_days"), F.count(F.lit(1)).alias("n_transfers"))
        .where("units_in_transit > 0 or units_received_window > 0")
    )


def transfer_star(details: DataFrame, headers: DataFrame, products: DataFrame, centres: DataFrame,
                  organisations: DataFrame) -> DataFrame:
    """Transfer lines with the codes of their product, destination and organisation."""
    return (
        details.join(headers, "traspaso_cabecera_id").join(products, "producto_id")
        .join(centres, details["centro_destino_id"] == centres["centro_id"])
        .join(organisations, "venta_organizacion_id")
        .select(F.col("organizacion_ventas_nombre").alias("brand"), F.col("sku_sap").alias("sku"),
                F.col("sku_padre_sap").alias("codigo_padre"), F.col("tienda_codigo_sap").alias("centro"),
                "fecha_creacion", "fecha_recepcion", "unidades")
    )
