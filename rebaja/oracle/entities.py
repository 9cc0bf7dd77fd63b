"""The same entities as SQL text for the DuckDB comparison."""

ENTITIES = {
    "fx_part": """
SELECT p_partkey, p_type, p_size, q,
       CASE q % 3 WHEN 0 THEN 'NORTE' WHEN 1 THEN 'CENTRO' ELSE 'SUR' END AS brand,
       CASE q % 6 WHEN 0 THEN 'NI' WHEN 1 THEN 'AD' WHEN 2 THEN 'PM' WHEN 3 THEN 'CAH' WHEN 4 THEN 'BM' ELSE 'ZZ' END
         AS prefix,
       CASE q % 6 WHEN 0 THEN 'NI' WHEN 1 THEN 'AD' WHEN 2 THEN 'PM' WHEN 3 THEN 'CAH' WHEN 4 THEN 'BM' ELSE 'ZZ' END
         || CAST(q AS VARCHAR) || '-' || p_type AS codigo_padre,
       p_size % 8 AS size_ix, CAST(round(p_retailprice * 100) AS DOUBLE) AS list_price
FROM (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INT) AS q FROM part) p""",
    "fx_products": """
SELECT DISTINCT brand, codigo_padre || '-' || CAST(size_ix AS VARCHAR) AS material,
       'W ' || p_type || ' ' || CAST(q AS VARCHAR) || ' ' || upper(CASE q % 4 WHEN 0 THEN 'Negro' WHEN 1 THEN 'Blanco'
         WHEN 2 THEN 'Azul' ELSE 'Rojo' END) || ' N° ' || talla AS material_descripcion,
       codigo_padre, talla,
       CASE WHEN q % 5 <> 0 THEN '78' || lpad(CAST(q AS VARCHAR), 4, '0') || CAST(size_ix AS VARCHAR) END AS ean11,
       prefix AS grupo_articulos,
       CASE q % 6 WHEN 0 THEN 'Nike' WHEN 1 THEN 'Adidas' WHEN 2 THEN 'Puma' WHEN 3 THEN 'Carhartt' WHEN 4 THEN 'Bamers'
                  ELSE 'Otra' END AS grupo_articulos_descripcion,
       CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM') THEN 'Footwear' ELSE 'Apparel' END AS primera_jerarquia,
       p_type AS segunda_jerarquia, p_type || '-' || CAST(q % 2 AS VARCHAR) AS tercera_jerarquia,
       CASE WHEN q % 2 = 0 THEN 'Hombre' ELSE 'Mujer' END AS genero,
       CASE WHEN q % 7 = 0 THEN 'Infantil' ELSE 'Adulto' END AS grupo_etario,
       CASE q % 4 WHEN 0 THEN 'Negro' WHEN 1 THEN 'Blanco' WHEN 2 THEN 'Azul' ELSE 'Rojo' END AS color1
FROM (SELECT *, CASE size_ix WHEN 0 THEN '6,5' WHEN 1 THEN '7' WHEN 2 THEN '7,5' WHEN 3 THEN '8' WHEN 4 THEN '8,5'
                    WHEN 5 THEN '9' WHEN 6 THEN '9,5' ELSE '11' END AS talla FROM fx_part)""",
    "fx_line": """
SELECT brand, CAST(l_orderkey AS VARCHAR) AS folio, l_orderkey, l_linenumber, l_returnflag, l_linestatus, o_orderdate,
       CASE WHEN l_linenumber = 7 AND l_linestatus = 'F' THEN 'NOTA DE CREDITO' ELSE 'BOLETA' END AS tipo_documento,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Retiro en Tienda' ELSE 'Despacho' END AS tipo_entrega,
       CASE WHEN o_orderpriority = '2-HIGH' AND l_linenumber = 1 THEN 'CUPON' END AS codigo_descuento,
       CASE WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN 'liquidacion'
            WHEN l_linestatus = 'F' AND l_linenumber = 5 THEN 'outlet' ELSE 'retail' END AS list_category,
       l_shipdate AS fecha, CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       CASE n_regionkey WHEN 4 THEN 'AB04' ELSE '200' || CAST(n_regionkey AS VARCHAR) END AS centro,
       codigo_padre || '-' || CAST(size_ix AS VARCHAR) AS sku, codigo_padre, q,
       CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS cantidad,
       list_price AS precio_lista, round(list_price * l_discount * 6) AS descuento,
       list_price - round(list_price * l_discount * 6) AS precio_final
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN fx_part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""",
    "fx_stores": """
SELECT centro, centro || '-' || r_name AS sucursal, CAST(r_regionkey AS VARCHAR) AS region
FROM (SELECT r_regionkey, r_name, CASE r_regionkey WHEN 4 THEN 'AB04' ELSE '200' || CAST(r_regionkey AS VARCHAR) END AS centro
      FROM region)""",
    "fx_stock": """
SELECT brand, fecha, centro || '-Tienda' AS store_id, sku,
       max(CAST((l_orderkey % 7) * (l_linenumber % 3) AS BIGINT)) AS stock_on_hand_units,
       max(CAST(l_orderkey % 4 AS BIGINT)) AS stock_in_transit_units,
       max(CAST((l_orderkey % 7) * (l_linenumber % 3) AS BIGINT)) + max(CAST(l_orderkey % 4 AS BIGINT)) AS total_stock_position_units
FROM fx_line GROUP BY brand, fecha, centro, sku""",
    "fx_costs": """
SELECT brand, codigo_padre AS sku, round(min(list_price) / 1.19::DOUBLE * (0.30::DOUBLE + 0.05::DOUBLE * (max(q) % 8))) AS cost
FROM fx_part WHERE q % 10 <> 0 GROUP BY brand, codigo_padre""",
    "fx_official_prices": """
SELECT brand, codigo_padre AS sku, max(list_price) AS list_price FROM fx_part WHERE q % 3 = 0 GROUP BY brand, codigo_padre""",
    "fx_reference_prices": """
SELECT brand, codigo_padre AS sku, max(list_price) AS precio_normal FROM fx_part WHERE q % 4 <> 1 GROUP BY brand, codigo_padre""",
    "fx_rebates": """
SELECT DISTINCT brand, codigo_padre AS parent_sku, DATE '1998-01-05' AS fecha_inicio, DATE '2001-12-31' AS fecha_termino,
       CAST(1000 * (1 + q % 3) AS DOUBLE) AS aporte_unitario FROM fx_part WHERE q % 4 = 0""",
    "fx_po": """
SELECT brand, l_orderkey AS oc_numero, sku, codigo_padre, centro, abs(cantidad) AS cantidad,
       CAST(fecha + INTERVAL 14 DAY AS DATE) AS fecha_entrega
FROM fx_line WHERE l_linestatus = 'O'""",
    "fx_receipts": """
SELECT brand, oc_numero, sku, cantidad - cantidad % 5 AS cantidad_recibida FROM fx_po WHERE oc_numero % 3 <> 0""",
    "fx_transfers": """
SELECT brand, sku, codigo_padre, centro, o_orderdate AS fecha_creacion,
       CASE WHEN fecha >= o_orderdate THEN fecha END AS fecha_recepcion, abs(cantidad) AS unidades
FROM fx_line WHERE l_returnflag = 'A'""",
    "fx_traffic": """
SELECT CASE user_id % 5 WHEN 4 THEN 'AB04' ELSE '200' || CAST(user_id % 5 AS VARCHAR) END AS tienda_id,
       ts - INTERVAL 9492 DAY AS fecha,
       CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS entradas,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS salidas, value AS tiempo_permanencia_prom
FROM events""",
    "fx_weather": """
SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(o_orderdate AS DATE) AS date,
       CAST(12 + count(*) % 15 AS DOUBLE) AS temp_max, CAST(2 + count(*) % 9 AS DOUBLE) AS temp_min,
       CAST((count(*) * 7) % 13 AS DOUBLE) AS precipitation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_regionkey, CAST(o_orderdate AS DATE)""",
    "fx_competitor_prices": """
SELECT brand, codigo_padre, competitor, comp_price, comp_list_price, comp_in_stock,
       CASE WHEN comp_price < comp_list_price THEN round(1 - comp_price / comp_list_price, 3) ELSE 0.0::DOUBLE END AS comp_discount
FROM (SELECT brand, codigo_padre, s_name AS competitor,
             round(lp * (0.80::DOUBLE + 0.05::DOUBLE * ((q + s_suppkey) % 8))) AS comp_price, lp AS comp_list_price,
             (q + s_suppkey) % 4 <> 0 AS comp_in_stock
      FROM (SELECT brand, codigo_padre, q, max(list_price) AS lp FROM fx_part GROUP BY brand, codigo_padre, q)
      JOIN (SELECT DISTINCT brand, codigo_padre, q, l_suppkey AS s_suppkey FROM lineitem JOIN fx_part ON l_partkey = p_partkey) USING (brand, codigo_padre, q) JOIN supplier USING (s_suppkey))""",
    "fx_contribution": """
SELECT brand, brand AS banner, sku, CAST(floor(descuento / 10) AS DOUBLE) AS contribucion_valor
FROM fx_line WHERE q % 5 = 0 AND cantidad > 0""",
}
