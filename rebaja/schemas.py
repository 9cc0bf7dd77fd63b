"""Declared schema of each input entity, and completion of absent columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "b": T.BooleanType(),
          "t": T.TimestampType(), "D": T.DateType()}


def _struct(text: str) -> T.StructType:
    fields = [item.split(":") for item in text.split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TRANSACTIONS = _struct(
    "brand:s folio:s tipo_documento:s canal:s tipo_entrega:s fecha:t centro:s sku:s descripcion:s "
    "cantidad:l precio_lista:d descuento:d precio_final:d codigo_descuento:s list_name:s list_category:s")
PRODUCTS = _struct(
    "brand:s material:s material_descripcion:s codigo_padre:s talla:s ean11:s grupo_articulos:s "
    "grupo_articulos_descripcion:s primera_jerarquia:s segunda_jerarquia:s tercera_jerarquia:s "
    "genero:s grupo_etario:s color1:s")
STORES = _struct("centro:s sucursal:s region:s")
STOCK = _struct("brand:s fecha:t store_id:s sku:s stock_on_hand_units:l stock_in_transit_units:l "
                "total_stock_position_units:l")
COSTS = _struct("brand:s sku:s cost:d")
OFFICIAL_PRICES = _struct("brand:s sku:s list_price:d")
REFERENCE_PRICES = _struct("brand:s sku:s precio_normal:d")
REBATES = _struct("brand:s parent_sku:s fecha_inicio:D fecha_termino:D aporte_unitario:d")
TRAFFIC = _struct("tienda_id:s fecha:t entradas:l salidas:l tiempo_permanencia_prom:d")
WEATHER = _struct("region:s date:D temp_max:d temp_min:d precipitation:d")
COMPETITOR_PRICES = _struct(
    "brand:s codigo_padre:s ean11:s competitor:s competitor_url:s comp_price:d comp_list_price:d "
    "comp_discount:d comp_in_stock:b match_method:s match_score:d scraped_at:t")
BACKORDER = _struct("brand:s cod_padre:s sku:s centro:s open_qty:d earliest_delivery:D n_open_pos:l")
REPLENISHMENT = _struct("brand:s cod_padre:s sku:s centro:s units_in_transit:d units_received_window:d "
                        "avg_transit_days:d n_transfers:l")
MARKDOWN_CONTRIBUTION = _struct("brand:s banner:s sku:s contribucion_valor:d")
ACTIONS_CSV = _struct(
    "brand:s parent_sku:s store:s store_name:s product:s category:s subcategory:s current_list_price:l "
    "current_price:l current_discount:s current_velocity:d recommended_price:l recommended_discount:s "
    "expected_velocity:d current_weekly_rev:l expected_weekly_rev:l rev_delta:l unit_cost:l margin_pct:d "
    "margin_delta:l urgency:s reasons:s model_confidence:d confidence_tier:s action_type:s vendor_brand:s")

DECISION_RECORD = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("user", T.StringType()), T.StructField("manual_price", T.DoubleType()),
    T.StructField("chain_scope", T.StringType()), T.StructField("chain_key", T.StringType()),
    T.StructField("estimated_impact", T.StructType([
        T.StructField("margin_pct", T.DoubleType()), T.StructField("velocity", T.DoubleType())])),
])
DECISIONS_JSON = T.StructType([
    T.StructField("week", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("decisions", T.MapType(T.StringType(), DECISION_RECORD)),
])
AUDIT = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("user_email", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("week", T.StringType()), T.StructField("timestamp", T.TimestampType()),
])


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the schema; columns the source lacks become typed NULLs."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
