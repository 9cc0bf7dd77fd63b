"""Column types of every registered query's result."""

RESULT_TYPES: dict[str, str] = {
    "read_transactions": (
        "brand:string folio:string tipo_documento:string tipo_entrega:string codigo_descuento:string "
        "list_category:string fecha:timestamp centro:string sku:string cantidad:bigint precio_lista:double "
        "descuento:double precio_final:double"
    ),
    "column_pruned_read": "sku:string centro:string fecha:timestamp cantidad:bigint precio_final:double",
    "latest_snapshot": (
        "brand:string week:date codigo_padre:string centro:string units:bigint revenue:double n_sizes:bigint "
        "avg_discount_rate:double"
    ),
    "union_brands": "codigo_padre:string centro:string week:date alert_reasons:string brand:string",
    "null_normalise": (
        "brand:string sku:string centro:string week:date discount_rate:double velocity_lift:double color1:string "
        "genero:string"
    ),
    "load_audit": "brand:string user_email:string action:string key:string timestamp:timestamp",
    "load_feedback": "brand:string week:date key:string implemented:boolean ts:timestamp",
    "transaction_tags": (
        "brand:string folio:string sku:string centro:string fecha:timestamp click_collect:boolean coupon:boolean "
        "credit_note:boolean extreme:boolean markdown_list:boolean clean:boolean kind:string"
    ),
    "exclude_service_skus": "brand:string sku:string n:bigint",
    "pick_target_week": "brand:string week:date",
    "filter_stores": "brand:string codigo_padre:string centro:string week:date velocity_4w:double",
    "filter_actions": "brand:string week:date parent_sku:string store:string urgency:string status:string",
    "weekly_sales": (
        "brand:string sku:string centro:string week:date units_sold:bigint gross_revenue:double txn_count:bigint "
        "click_collect_units:bigint total_discount:double total_list_value:double avg_precio_lista:double "
        "avg_precio_final:double min_precio_lista:double max_precio_lista:double units_returned:bigint "
        "instore_units:bigint click_collect_ratio:double net_units:bigint discount_rate:double"
    ),
    "weekly_sales_all_prices": (
        "brand:string sku:string centro:string week:date units_sold:bigint avg_precio_final:double "
        "avg_precio_lista:double"
    ),
    "apply_official_prices": "brand:string sku:string centro:string week:date avg_precio_lista:double",
    "velocity_features": (
        "brand:string sku:string centro:string week:date velocity_1w:double velocity_2w:double velocity_4w:double "
        "velocity_8w:double velocity_trend:double cumulative_units:bigint instore_velocity_4w:double"
    ),
    "velocity_dense": (
        "brand:string centro:string week:date n_series:bigint units_sold:bigint velocity_4w:double velocity_8w:double"
    ),
    "product_age": (
        "brand:string sku:string centro:string week:date first_sale_date:timestamp product_age_weeks:double"
    ),
    "price_features": (
        "brand:string sku:string centro:string week:date price_changed:bigint price_change_pct:double "
        "has_discount:bigint weeks_since_discount:bigint cumulative_disc_weeks:bigint disc_exposure_rate:double "
        "max_discount_rate:double"
    ),
    "size_curve_completeness": (
        "brand:string sku:string centro:string week:date codigo_padre:string size_curve_completeness:double"
    ),
    "seasonality_features": (
        "week:date month:bigint week_of_year:bigint quarter:bigint month_sin:double month_cos:double week_sin:double "
        "week_cos:double"
    ),
    "stock_features": (
        "brand:string sku:string centro:string week:date stock_on_hand:bigint stock_in_transit:bigint "
        "stock_total:bigint stock_out_days:bigint weeks_of_cover:double stock_to_sales_ratio:double"
    ),
    "backorder_signal": (
        "brand:string cod_padre:string sku:string centro:string open_qty:double earliest_delivery:date "
        "n_open_pos:bigint"
    ),
    "backorder_features": (
        "brand:string sku:string centro:string week:date open_po_units:double n_open_pos:bigint days_to_delivery:bigint"
    ),
    "replenishment_signal": (
        "brand:string cod_padre:string sku:string centro:string units_in_transit:double units_received_window:double "
        "avg_transit_days:double n_transfers:bigint"
    ),
    "replenishment_features": (
        "brand:string sku:string centro:string week:date units_in_transit:double units_received_window:double "
        "avg_transit_days:double n_transfers:bigint"
    ),
    "size_sales_share": (
        "brand:string sku:string sku_total_units:bigint codigo_padre:string size_sales_share:double size_rank:bigint"
    ),
    "traffic_weekly": "centro:string week:date weekly_entries:bigint weekly_exits:bigint avg_dwell_time:double",
    "foot_traffic_features": (
        "brand:string sku:string centro:string week:date weekly_entries:bigint avg_dwell_time:double "
        "conversion_rate:double"
    ),
    "product_attributes": (
        "brand:string sku:string centro:string week:date primera_jerarquia:string segunda_jerarquia:string "
        "tercera_jerarquia:string genero:string grupo_etario:string color1:string"
    ),
    "markdown_contribution": (
        "brand:string sku:string centro:string week:date mkdown_contrib_2024_clp:double "
        "mkdown_contrib_2024_present:bigint mkdown_contrib_2024_parent_total:double"
    ),
    "weekly_weather": (
        "region:string week:date avg_temp:double max_temp:double min_temp:double total_rain:double rain_days:bigint "
        "temp_deviation:double is_rainy_week:bigint"
    ),
    "store_weather": (
        "centro:string week:date avg_temp:double max_temp:double min_temp:double total_rain:double rain_days:bigint "
        "temp_deviation:double is_rainy_week:bigint"
    ),
    "target_variables": (
        "brand:string sku:string centro:string week:date will_discount_4w:bigint future_max_disc_4w:double "
        "future_velocity_2w:double velocity_lift:double"
    ),
    "target_variables_strict": (
        "brand:string sku:string centro:string week:date will_discount_4w:bigint future_max_disc_4w:double"
    ),
    "filter_active_rows": "brand:string sku:string centro:string week:date",
    "empirical_lift": "brand:string step:double lift:double",
    "empirical_lift_healthy": "brand:string step:double lift:double",
    "margin_targets": (
        "brand:string sku:string centro:string week:date optimal_disc_margin:double should_reprice:double "
        "optimal_profit:double"
    ),
    "child_features": (
        "brand:string codigo_padre:string sku:string centro:string week:date units_sold:bigint gross_revenue:double "
        "txn_count:bigint click_collect_units:bigint total_discount:double total_list_value:double "
        "avg_precio_lista:double avg_precio_final:double min_precio_lista:double max_precio_lista:double "
        "units_returned:bigint instore_units:bigint click_collect_ratio:double net_units:bigint discount_rate:double "
        "velocity_1w:double velocity_2w:double velocity_4w:double velocity_8w:double cumulative_units:bigint "
        "instore_velocity_4w:double velocity_trend:double has_discount:bigint price_changed:bigint "
        "price_change_pct:double cumulative_disc_weeks:bigint max_discount_rate:double weeks_since_discount:bigint "
        "disc_exposure_rate:double future_velocity_2w:double will_discount_4w:bigint future_max_disc_4w:double "
        "velocity_lift:double first_sale_date:timestamp product_age_weeks:double size_sales_share:double "
        "size_rank:bigint primera_jerarquia:string segunda_jerarquia:string tercera_jerarquia:string genero:string "
        "grupo_etario:string color1:string size_curve_completeness:double month:bigint week_of_year:bigint "
        "quarter:bigint month_sin:double month_cos:double week_sin:double week_cos:double stock_on_hand:bigint "
        "stock_in_transit:bigint stock_total:bigint stock_out_days:bigint weeks_of_cover:double "
        "stock_to_sales_ratio:double open_po_units:double n_open_pos:bigint days_to_delivery:bigint "
        "units_in_transit:double units_received_window:double avg_transit_days:double n_transfers:bigint "
        "avg_temp:double max_temp:double min_temp:double total_rain:double rain_days:bigint temp_deviation:double "
        "is_rainy_week:bigint weekly_entries:bigint avg_dwell_time:double conversion_rate:double "
        "mkdown_contrib_2024_clp:double mkdown_contrib_2024_present:bigint mkdown_contrib_2024_parent_total:double "
        "optimal_disc_margin:double should_reprice:double optimal_profit:double"
    ),
    "elasticity_panel": (
        "brand:string codigo_padre:string sku:string centro:string week:date units:bigint txn_count:bigint "
        "avg_price:double avg_list_price:double primera_jerarquia:string segunda_jerarquia:string month:bigint "
        "week_num:double ln_units:double ln_price:double discount_depth:double precio_normal:double "
        "is_normal_price:boolean md_tier_15:bigint md_tier_20:bigint md_tier_30:bigint md_tier_40:bigint"
    ),
    "price_variation_gate": "brand:string codigo_padre:string n:bigint price_cv:double",
    "elasticity_fast": (
        "brand:string codigo_padre:string n_observations:bigint price_cv:double avg_price:double avg_units_week:double "
        "primera_jerarquia:string segunda_jerarquia:string elasticity:double r2:double confidence:string"
    ),
    "elasticity_by_parent": (
        "brand:string codigo_padre:string n_observations:bigint avg_price:double avg_units_week:double price_cv:double "
        "elasticity:double r2:double confidence:string primera_jerarquia:string segunda_jerarquia:string"
    ),
    "elasticity_by_parent_tiers": (
        "brand:string codigo_padre:string n_observations:bigint avg_price:double avg_units_week:double price_cv:double "
        "elasticity:double r2:double confidence:string primera_jerarquia:string segunda_jerarquia:string"
    ),
    "elasticity_by_category": (
        "brand:string primera_jerarquia:string segunda_jerarquia:string elasticity:double r2:double "
        "n_observations:bigint price_cv:double"
    ),
    "attach_elasticity": (
        "brand:string sku:string centro:string week:date price_elasticity:double optimal_discount_rev:double"
    ),
    "elasticity_summary": (
        "brand:string level:string name:string sku_count:bigint median_elasticity:double elastic_count:bigint "
        "inelastic_count:bigint high_confidence:bigint"
    ),
    "elasticity_bands": "brand:string band:string n:bigint share:double",
    "parent_weekly_sales": (
        "brand:string codigo_padre:string centro:string week:date units:bigint revenue:double n_sizes:bigint "
        "avg_discount_rate:double"
    ),
    "densify_weeks": (
        "brand:string codigo_padre:string centro:string week:date n_obs:bigint units:bigint revenue:double "
        "avg_discount_rate:double n_sizes:bigint"
    ),
    "lifecycle_stage": (
        "brand:string codigo_padre:string centro:string week:date units:bigint revenue:double avg_discount_rate:double "
        "n_sizes:bigint vel_4w:double vel_8w:double vel_expanding:double week_idx:bigint vel_ratio:double "
        "vel_trend:double lifecycle_stage:string lifecycle_position:double est_weeks_remaining:double"
    ),
    "derive_season": (
        "brand:string codigo_padre:string first_sale_week:date derived_season:string derived_season_year:bigint "
        "derived_season_full:string"
    ),
    "stage_summary": (
        "brand:string lifecycle_stage:string n:bigint avg_units:double avg_discount:double share:double"
    ),
    "size_availability_stock": (
        "brand:string codigo_padre:string centro:string week:date active_sizes_4w:bigint core_sizes_active:bigint "
        "total_sizes_ever:bigint core_sizes_total:bigint peak_sizes:bigint lost_sizes:bigint size_completeness:double "
        "core_sizes_lost:bigint core_completeness:double attrition_rate:double fragmentation_index:double source:string"
    ),
    "size_availability_sales": (
        "brand:string codigo_padre:string centro:string week:date active_sizes_4w:bigint core_sizes_active:bigint "
        "total_sizes_ever:bigint core_sizes_total:bigint peak_sizes:bigint lost_sizes:bigint size_completeness:double "
        "core_sizes_lost:bigint core_completeness:double attrition_rate:double fragmentation_index:double source:string"
    ),
    "size_alerts": (
        "brand:string codigo_padre:string centro:string week:date active_sizes_4w:bigint core_sizes_active:bigint "
        "total_sizes_ever:bigint core_sizes_total:bigint peak_sizes:bigint lost_sizes:bigint size_completeness:double "
        "core_sizes_lost:bigint core_completeness:double attrition_rate:double fragmentation_index:double source:string "
        "alert_reasons:string"
    ),
    "size_alert_view": (
        "brand:string parent_sku:string store:string active_sizes:bigint total_sizes:bigint attrition_rate:double "
        "core_completeness:double alert_reasons:string"
    ),
    "size_markdown_relation": (
        "brand:string codigo_padre:string centro:string week:date attrition_rate:double avg_discount_rate:double "
        "lifecycle_stage:string future_disc_4w:double"
    ),
    "size_markdown_buckets": "brand:string kind:string bucket:string n:bigint avg_future_disc:double",
    "size_health_histogram": "brand:string band:string n:bigint share:double",
    "competitor_features": (
        "brand:string sku:string centro:string week:date comp_min_price:bigint comp_avg_price:bigint "
        "comp_max_price:bigint comp_count:bigint comp_any_discount:bigint comp_max_discount:double "
        "comp_in_stock_count:bigint comp_price_index:double comp_price_gap_pct:double comp_undercut:bigint "
        "comp_discount_pressure:double"
    ),
    "category_interactions": (
        "brand:string sku:string centro:string week:date cat_x_lifecycle:bigint cat_x_season:bigint "
        "cat_x_velocity:bigint cat_x_age:bigint"
    ),
    "velocity_terciles": "brand:string q33:double q66:double",
    "enhanced_features": (
        "brand:string codigo_padre:string primera_jerarquia:string segunda_jerarquia:string centro:string week:date "
        "sku:string units_sold:bigint gross_revenue:double txn_count:bigint click_collect_units:bigint "
        "total_discount:double total_list_value:double avg_precio_lista:double avg_precio_final:double "
        "min_precio_lista:double max_precio_lista:double units_returned:bigint instore_units:bigint "
        "click_collect_ratio:double net_units:bigint discount_rate:double velocity_1w:double velocity_2w:double "
        "velocity_4w:double velocity_8w:double cumulative_units:bigint instore_velocity_4w:double velocity_trend:double "
        "has_discount:bigint price_changed:bigint price_change_pct:double cumulative_disc_weeks:bigint "
        "max_discount_rate:double weeks_since_discount:bigint disc_exposure_rate:double future_velocity_2w:double "
        "will_discount_4w:bigint future_max_disc_4w:double velocity_lift:double first_sale_date:timestamp "
        "product_age_weeks:double size_sales_share:double size_rank:bigint tercera_jerarquia:string genero:string "
        "grupo_etario:string color1:string size_curve_completeness:double month:bigint week_of_year:bigint "
        "quarter:bigint month_sin:double month_cos:double week_sin:double week_cos:double stock_on_hand:bigint "
        "stock_in_transit:bigint stock_total:bigint stock_out_days:bigint weeks_of_cover:double "
        "stock_to_sales_ratio:double open_po_units:double n_open_pos:bigint days_to_delivery:bigint "
        "units_in_transit:double units_received_window:double avg_transit_days:double n_transfers:bigint "
        "avg_temp:double max_temp:double min_temp:double total_rain:double rain_days:bigint temp_deviation:double "
        "is_rainy_week:bigint weekly_entries:bigint avg_dwell_time:double conversion_rate:double "
        "mkdown_contrib_2024_clp:double mkdown_contrib_2024_present:bigint mkdown_contrib_2024_parent_total:double "
        "optimal_disc_margin:double should_reprice:double optimal_profit:double lifecycle_stage_code:bigint "
        "lifecycle_position:double attrition_rate:double core_completeness:double fragmentation_index:double "
        "active_sizes_4w:bigint total_sizes_ever:bigint price_elasticity:double comp_min_price:bigint "
        "comp_avg_price:bigint comp_max_price:bigint comp_count:bigint comp_any_discount:bigint "
        "comp_max_discount:double comp_in_stock_count:bigint comp_price_index:double comp_price_gap_pct:double "
        "comp_undercut:bigint comp_discount_pressure:double is_fall_winter:bigint cat_x_lifecycle:bigint "
        "cat_x_season:bigint cat_x_velocity:bigint cat_x_age:bigint"
    ),
    "weighted_size_features": (
        "brand:string codigo_padre:string centro:string week:date weighted_size_avail:double revenue_at_risk_pct:double "
        "top3_sizes_in_stock:double"
    ),
    "parent_features": (
        "brand:string codigo_padre:string centro:string week:date units_sold:bigint net_units:bigint "
        "gross_revenue:double velocity_1w:double velocity_2w:double velocity_4w:double velocity_8w:double "
        "cumulative_units:bigint units_returned:bigint click_collect_units:bigint instore_units:bigint "
        "instore_velocity_4w:double total_list_value:double total_discount:double txn_count:bigint "
        "mkdown_contrib_2024_clp:double stock_on_hand:bigint stock_in_transit:bigint stock_total:bigint "
        "avg_precio_lista:double avg_precio_final:double discount_rate:double optimal_disc_margin:double "
        "max_precio_lista:double has_discount:bigint max_discount_rate:double cumulative_disc_weeks:bigint "
        "product_age_weeks:double price_changed:bigint will_discount_4w:bigint future_max_disc_4w:double "
        "should_reprice:double stock_out_days:bigint weekly_entries:bigint avg_dwell_time:double "
        "price_elasticity:double lifecycle_stage_code:bigint lifecycle_position:double attrition_rate:double "
        "core_completeness:double fragmentation_index:double is_fall_winter:bigint month:bigint week_of_year:bigint "
        "quarter:bigint month_sin:double month_cos:double week_sin:double week_cos:double avg_temp:double "
        "max_temp:double min_temp:double total_rain:double rain_days:bigint temp_deviation:double is_rainy_week:bigint "
        "comp_min_price:bigint comp_avg_price:bigint comp_max_price:bigint comp_count:bigint comp_any_discount:bigint "
        "comp_max_discount:double comp_in_stock_count:bigint mkdown_contrib_2024_parent_total:double "
        "min_precio_lista:double weeks_since_discount:bigint first_sale_date:timestamp disc_exposure_rate:double "
        "price_change_pct:double comp_price_index:double comp_price_gap_pct:double comp_undercut:bigint "
        "comp_discount_pressure:double cat_x_lifecycle:bigint cat_x_season:bigint cat_x_velocity:bigint "
        "cat_x_age:bigint mkdown_contrib_2024_present:bigint future_velocity_2w:double optimal_profit:double "
        "pct_sizes_in_stock:double weeks_of_cover:double stock_to_sales_ratio:double weighted_size_avail:double "
        "revenue_at_risk_pct:double top3_sizes_in_stock:double primera_jerarquia:string segunda_jerarquia:string "
        "genero:string grupo_etario:string velocity_trend:double conversion_rate:double velocity_lift:double "
        "size_curve_completeness:double click_collect_ratio:double"
    ),
    "parent_signals": (
        "brand:string codigo_padre:string centro:string week:date open_po_units:double n_open_pos:bigint "
        "units_in_transit:double units_received_window:double n_transfers:bigint days_to_delivery:bigint"
    ),
    "active_rebates": "brand:string parent_sku:string week:date rebate:double",
    "valid_prices": "brand:string sku:string list_price:double",
    "prefix_cost_lookup": "brand:string sku:string cost:double",
    "combine_costs": "brand:string sku:string cost:double",
    "latest_costs": "brand:string sku:string cost:bigint n_children_with_cost:bigint n_children_total:bigint",
    "price_list_names": "brand:string folio:string centro:string list_name:string list_category:string",
    "enrich_price_list": (
        "brand:string folio:string centro:string sku:string fecha:timestamp cantidad:bigint list_name:string "
        "list_category:string"
    ),
    "transfer_star": (
        "brand:string sku:string codigo_padre:string centro:string fecha_creacion:timestamp fecha_recepcion:timestamp "
        "unidades:bigint"
    ),
    "vendor_brand": "brand:string material:string vendor_brand:string",
    "product_names": "brand:string material:string clean_name:string model:string normal_name:string",
    "store_names": "centro:string store_name:string channel:string",
    "size_numbers": "brand:string material:string size_number:double",
    "format_values": (
        "brand:string folio:string sku:string fecha:timestamp precio_final:double clp:string pct_text:string "
        "pct_value:double"
    ),
    "snap_prices": (
        "brand:string folio:string sku:string fecha:timestamp precio_final:double nearest:bigint up:bigint down:bigint "
        "nearest_big:bigint up_big:bigint down_big:bigint step:double"
    ),
    "expected_velocity": (
        "brand:string codigo_padre:string centro:string week:date new_step:double down:double both_ways:double"
    ),
    "pricing_rows": (
        "brand:string codigo_padre:string centro:string week:date elasticity:double disc_rate:double "
        "product_name:string total_sizes_catalog:bigint store_name:string raw_cost:bigint rebate_amount:bigint "
        "unit_cost:bigint current_step:double price_now:bigint n_sell:bigint"
    ),
    "cost_trio": (
        "brand:string codigo_padre:string centro:string week:date raw_cost:bigint rebate_amount:bigint unit_cost:bigint"
    ),
    "price_increase_pass": (
        "brand:string week:date parent_sku:string store:string store_name:string product:string category:string "
        "subcategory:string sizes_selling:bigint sizes_total:bigint product_age_weeks:bigint stock_on_hand:bigint "
        "weeks_of_cover:double current_list_price:bigint current_price:bigint current_discount:string "
        "current_velocity:double recommended_price:bigint recommended_discount:string expected_velocity:double "
        "current_weekly_rev:bigint expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint raw_cost:bigint "
        "rebate_amount:bigint margin_pct:double margin_delta:bigint urgency:string reasons:string "
        "model_confidence:double confidence_tier:string action_type:string vendor_brand:string "
        "click_collect_ratio:double"
    ),
    "markdown_pass": (
        "brand:string week:date parent_sku:string store:string store_name:string product:string category:string "
        "subcategory:string sizes_selling:bigint sizes_total:bigint product_age_weeks:bigint stock_on_hand:bigint "
        "weeks_of_cover:double current_list_price:bigint current_price:bigint current_discount:string "
        "current_velocity:double recommended_price:bigint recommended_discount:string expected_velocity:double "
        "current_weekly_rev:bigint expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint raw_cost:bigint "
        "rebate_amount:bigint margin_pct:double margin_delta:bigint urgency:string reasons:string "
        "model_confidence:double confidence_tier:string action_type:string vendor_brand:string "
        "click_collect_ratio:double"
    ),
    "urgency": (
        "brand:string codigo_padre:string centro:string week:date score:bigint urgency:string reasons:string "
        "tier:string"
    ),
    "weekly_actions": (
        "brand:string week:date parent_sku:string store:string store_name:string product:string category:string "
        "subcategory:string sizes_selling:bigint sizes_total:bigint product_age_weeks:bigint stock_on_hand:bigint "
        "weeks_of_cover:double current_list_price:bigint current_price:bigint current_discount:string "
        "current_velocity:double recommended_price:bigint recommended_discount:string expected_velocity:double "
        "current_weekly_rev:bigint expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint raw_cost:bigint "
        "rebate_amount:bigint margin_pct:double margin_delta:bigint urgency:string reasons:string "
        "model_confidence:double confidence_tier:string action_type:string vendor_brand:string "
        "click_collect_ratio:double ecomm_price:double ecomm_discount:double ecomm_velocity:double "
        "ecomm_price_gap_pct:double"
    ),
    "weekly_actions_all_weeks": (
        "brand:string week:date parent_sku:string store:string store_name:string product:string category:string "
        "subcategory:string sizes_selling:bigint sizes_total:bigint product_age_weeks:bigint stock_on_hand:bigint "
        "weeks_of_cover:double current_list_price:bigint current_price:bigint current_discount:string "
        "current_velocity:double recommended_price:bigint recommended_discount:string expected_velocity:double "
        "current_weekly_rev:bigint expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint raw_cost:bigint "
        "rebate_amount:bigint margin_pct:double margin_delta:bigint urgency:string reasons:string "
        "model_confidence:double confidence_tier:string action_type:string vendor_brand:string "
        "click_collect_ratio:double ecomm_price:double ecomm_discount:double ecomm_velocity:double "
        "ecomm_price_gap_pct:double"
    ),
    "published_latest": (
        "brand:string week:date parent_sku:string store:string store_name:string product:string category:string "
        "subcategory:string sizes_selling:bigint sizes_total:bigint product_age_weeks:bigint stock_on_hand:bigint "
        "weeks_of_cover:double current_list_price:bigint current_price:bigint current_discount:string "
        "current_velocity:double recommended_price:bigint recommended_discount:string expected_velocity:double "
        "current_weekly_rev:bigint expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint raw_cost:bigint "
        "rebate_amount:bigint margin_pct:double margin_delta:bigint urgency:string reasons:string "
        "model_confidence:double confidence_tier:string action_type:string vendor_brand:string "
        "click_collect_ratio:double ecomm_price:double ecomm_discount:double ecomm_velocity:double "
        "ecomm_price_gap_pct:double"
    ),
    "published_changes": "brand:string parent_sku:string store:string week:date recommended_price:bigint previous_price:bigint",
    "action_orders": "sort:string brand:string parent_sku:string store:string place:bigint",
    "page_by_place": "brand:string parent_sku:string store:string place:bigint",
    "order_actions": (
        "brand:string week:date parent_sku:string store:string urgency:string rev_delta:bigint place:bigint"
    ),
    "page_of_actions": "brand:string parent_sku:string store:string current_velocity:double",
    "channel_actions": (
        "brand:string week:date parent_sku:string channel:string product:string category:string subcategory:string "
        "vendor_brand:string n_stores:bigint stores_in_channel:string has_stock_data:boolean channel_stock:bigint "
        "current_list_price:bigint current_price:bigint current_discount:string current_velocity:double "
        "recommended_price:bigint recommended_discount:string expected_velocity:double current_weekly_rev:bigint "
        "expected_weekly_rev:bigint rev_delta:bigint unit_cost:bigint rebate_amount:bigint margin_pct:double "
        "margin_delta:bigint urgency:string reasons:string confidence_tier:string action_type:string "
        "per_store_variance_pct:double mandatory_review:boolean aggregation_method:string chain_uniform_profit:double "
        "sum_per_store_profit:double gap_abs_clp:double gap_pct:double"
    ),
    "channel_variance": "brand:string week:date parent_sku:string channel:string variance_pct:double",
    "top_reasons": "brand:string week:date parent_sku:string channel:string reasons:string",
    "channel_gap_stats": (
        "brand:string week:date n_channel_actions:bigint n_mandatory_review:bigint gap_pct_mean:double "
        "gap_pct_median:double gap_pct_p75:double gap_pct_p95:double total_chain_uniform_profit:double "
        "total_sum_per_store_profit:double variance_pct_mean:double pct_fallback:double"
    ),
    "manual_price_impact": (
        "brand:string parent_sku:string store:string manual_price:double snapped_price:bigint velocity:double "
        "weekly_revenue:bigint margin_pct:double margin_delta:bigint warning:string"
    ),
    "promotion_grid": (
        "brand:string discount:double n_items:bigint units:double revenue:double margin:double is_best:boolean"
    ),
    "recommendations": (
        "brand:string week:date rank:bigint sku:string product_name:string talla:string store_code:string "
        "parent_sku:string markdown_probability:double confidence:string recommended_depth:double priority_score:double "
        "weekly_velocity:double velocity_trend:double currently_discounted:bigint estimated_weekly_revenue:double"
    ),
    "recommendations_by_parent": (
        "brand:string week:date parent_sku:string n_variants:bigint avg_probability:double avg_depth:double "
        "max_priority:double rank:bigint"
    ),
    "child_scores_to_parent": (
        "brand:string codigo_padre:string centro:string week:date velocity_4w:double velocity_8w:double "
        "avg_precio_lista:double discount_rate:double markdown_probability:double sizes_selling:bigint "
        "velocity_trend:double"
    ),
    "cross_store_alerts": (
        "brand:string codigo_padre:string centro:string week:date channel:string avg_precio_final:double "
        "discount_rate:double n_stores:bigint median_price:double price_spread:double discount_spread:double "
        "bm_price_spread:double ecomm_gap:double sync_price:double alert_reasons:string stock_on_hand:bigint "
        "weeks_of_cover:double velocity_4w:double"
    ),
    "alert_reason_counts": "brand:string reason:string n:bigint",
    "cross_store_view": (
        "brand:string parent_sku:string n_stores:bigint price_spread:double discount_spread:double sync_price:bigint "
        "alert_reasons:string stores:string product:string"
    ),
    "decisions_by_formula": "brand:string week:date key:string status:string manual_price:double ts:timestamp",
    "apply_decisions": "brand:string week:date key:string status:string manual_price:double ts:timestamp",
    "chain_fanout": "brand:string week:date key:string status:string chain_key:string",
    "planner_transition": "brand:string week:date key:string status:string bm_status:string planner_status:string",
    "planner_queue": (
        "brand:string week:date parent_sku:string store:string key:string bm_status:string manual_price:double"
    ),
    "planner_roster": "brand:string name:string n:bigint rev_delta:bigint",
    "export_rows": (
        "brand:string week:date parent_sku:string store:string status:string recommended_price:bigint margin_pct:double "
        "expected_velocity:double section:string"
    ),
    "eval_weeks": "brand:string week:date",
    "actual_metrics": (
        "brand:string week:date parent_sku:string store:string actual_units:bigint actual_revenue:double "
        "n_weeks_observed:bigint actual_velocity:double actual_weekly_rev:double"
    ),
    "outcomes": (
        "brand:string decision_week:date parent_sku:string store:string action_type:string confidence_tier:string "
        "status:string implemented_price:bigint baseline_velocity:double predicted_velocity:double "
        "actual_velocity:double velocity_error:double velocity_error_pct:double baseline_weekly_rev:double "
        "predicted_weekly_rev:double actual_weekly_rev:double rev_error:double rev_error_pct:double "
        "actual_lift_vs_baseline:double predicted_lift_vs_baseline:double direction_correct:boolean "
        "actual_margin_pct:double data_quality:string n_weeks_observed:bigint actual_units:double"
    ),
    "outcomes_all_weeks": (
        "brand:string decision_week:date parent_sku:string store:string action_type:string confidence_tier:string "
        "status:string implemented_price:bigint baseline_velocity:double predicted_velocity:double "
        "actual_velocity:double velocity_error:double velocity_error_pct:double baseline_weekly_rev:double "
        "predicted_weekly_rev:double actual_weekly_rev:double rev_error:double rev_error_pct:double "
        "actual_lift_vs_baseline:double predicted_lift_vs_baseline:double direction_correct:boolean "
        "actual_margin_pct:double data_quality:string n_weeks_observed:bigint actual_units:double"
    ),
    "outcome_summary": (
        "brand:string level:string name:string n:bigint weeks_evaluated:bigint median_velocity_error_pct:double "
        "pct_direction_correct:double avg_actual_rev_lift:double lift_capture_rate:double"
    ),
    "outcome_details": (
        "brand:string decision_week:date parent_sku:string store:string action_type:string confidence_tier:string "
        "status:string implemented_price:bigint baseline_velocity:double predicted_velocity:double "
        "actual_velocity:double velocity_error:double velocity_error_pct:double baseline_weekly_rev:double "
        "predicted_weekly_rev:double actual_weekly_rev:double rev_error:double rev_error_pct:double "
        "actual_lift_vs_baseline:double predicted_lift_vs_baseline:double direction_correct:boolean "
        "actual_margin_pct:double data_quality:string n_weeks_observed:bigint actual_units:double"
    ),
    "worst_predictions": (
        "brand:string parent_sku:string store:string predicted_velocity:double actual_velocity:double "
        "velocity_error_pct:double confidence_tier:string decision_week:date"
    ),
    "brand_overview": (
        "brand:string week:date total_actions:bigint decided:bigint approved:bigint pending:bigint increases:bigint "
        "decreases:bigint rev_delta:bigint margin_delta:bigint thin_margin_count:bigint"
    ),
    "impact_breakdown": (
        "brand:string dimension:string name:string rev_delta:bigint margin_delta:bigint n:bigint rank:bigint"
    ),
    "action_distributions": "brand:string dimension:string value:string n:bigint",
    "weekly_report": (
        "brand:string week:date total:bigint high:bigint medium:bigint increases:bigint decreases:bigint "
        "rev_delta:bigint margin_delta:bigint top_opportunities:string competitor_products:bigint "
        "cross_store_alerts:bigint"
    ),
    "store_roster": (
        "brand:string name:string total:bigint pending:bigint decided:bigint high:bigint medium:bigint rev_delta:bigint "
        "avg_click_collect:double"
    ),
    "vendor_roster": (
        "brand:string name:string total:bigint pending:bigint decided:bigint high:bigint medium:bigint rev_delta:bigint "
        "avg_click_collect:double"
    ),
    "product_grid": (
        "brand:string parent_sku:string product:string category:string subcategory:string vendor_brand:string "
        "age:bigint bm_stores:bigint bm_price:bigint bm_recommended:bigint bm_velocity:double bm_rev_delta:bigint "
        "bm_pending:bigint ecom_stores:bigint ecom_price:bigint ecom_recommended:bigint ecom_velocity:double "
        "ecom_rev_delta:bigint ecom_pending:bigint category_priority:bigint"
    ),
    "chain_view": (
        "brand:string parent_sku:string total_velocity:double total_rev_delta:bigint pending:bigint ecomm_stores:bigint "
        "bm_stores:bigint ecomm_pending:bigint bm_pending:bigint consensus_discount:string consensus_stores:bigint"
    ),
    "decision_kpis": (
        "brand:string total:bigint reviewed:bigint approved:bigint rejected:bigint undecided:bigint "
        "approved_rev_delta:bigint approved_margin_delta:bigint progress_pct:bigint"
    ),
    "data_quality": "brand:string measure:string name:string value:double",
    "markdown_events": (
        "brand:string sku:string centro:string week:date has_discount:bigint markdown_event:bigint "
        "first_markdown_week:date"
    ),
    "first_markdown_dataset": (
        "brand:string sku:string centro:string week:date first_discount_week:date target_first_markdown_4w:bigint"
    ),
    "walk_forward_metrics": (
        "brand:string week:date total_skus:bigint actual_positives:bigint pos_avg_prob:double neg_avg_prob:double "
        "top_k:bigint precision_at_k:double depth_mae:double revenue_at_risk:double recall_at_k:double"
    ),
    "timing_delta": (
        "brand:string sku:string centro:string model_first_flag:date actual_first_markdown:date delta_weeks:double"
    ),
    "timing_buckets": "brand:string bucket:string n:bigint",
    "depth_accuracy": (
        "brand:string sku:string centro:string week:date primera_jerarquia:string segunda_jerarquia:string "
        "discount_rate:double model_depth:double depth_delta:double model_prob:double units_sold:bigint "
        "gross_revenue:double depth_class:string"
    ),
    "revenue_impact": (
        "brand:string depth_total_savings:double depth_avg_weekly_savings:double annualised_savings:double "
        "flagged_early:bigint flagged_late:bigint avg_early_weeks:double avg_late_weeks:double"
    ),
    "depth_breakdown": (
        "brand:string level:string name:string n:bigint avg_actual_disc:double avg_model_disc:double "
        "avg_depth_delta:double total_revenue:double"
    ),
    "competitor_by_parent": (
        "brand:string codigo_padre:string comp_min_price:bigint comp_avg_price:bigint comp_max_price:bigint "
        "comp_count:bigint comp_any_discount:bigint comp_max_discount:double comp_in_stock_count:bigint"
    ),
    "competitor_summary": "brand:string parent_sku:string n_competitors:bigint competitors:string",
    "competitor_coverage": "brand:string competitor:string parents:bigint",
    "price_position": (
        "brand:string parent_sku:string our_price:bigint comp_min:bigint comp_avg:bigint gap_pct:double position:string "
        "cheapest_site:string n_competitors:bigint"
    ),
    "position_summary": (
        "brand:string total_products:bigint cheaper:bigint parity:bigint expensive:bigint cheaper_pct:bigint "
        "parity_pct:bigint expensive_pct:bigint avg_price_index:double"
    ),
    "competitor_breakdown": (
        "brand:string competitor:string products:bigint cheapest_pct:bigint avg_gap_pct:double"
    ),
    "position_extremes": (
        "brand:string parent_sku:string our_price:bigint comp_min:bigint comp_avg:bigint gap_pct:double position:string "
        "cheapest_site:string n_competitors:bigint side:string"
    ),
    "opportunities": (
        "brand:string parent_sku:string our_price:bigint comp_min:bigint velocity:double margin_impact:double"
    ),
    "threats": (
        "brand:string parent_sku:string our_price:bigint comp_min:bigint cheapest_site:string gap_pct:double "
        "severity:string revenue_at_risk:bigint"
    ),
    "price_movements": (
        "brand:string codigo_padre:string competitor:string snapshot:date prev_price:double comp_price:double "
        "change_pct:double movement:string"
    ),
    "extract_offers": (
        "page_id:string name:string comp_price:bigint comp_list_price:bigint comp_in_stock:boolean comp_discount:double"
    ),
    "extract_offers_raw_pages": "page_id:bigint",
    "build_catalog": (
        "brand:string codigo_padre:string product_name:string vendor_brand:string primera_jerarquia:string "
        "segunda_jerarquia:string ean11:string"
    ),
    "match_offers": (
        "brand:string codigo_padre:string competitor:string product_name:string vendor_brand:string "
        "primera_jerarquia:string segunda_jerarquia:string ean11:string offer_id:string name:string offer_brand:string "
        "comp_price:bigint comp_list_price:bigint comp_in_stock:boolean match_method:string match_score:double"
    ),
    "match_offers_subset": (
        "brand:string codigo_padre:string competitor:string comp_price:bigint match_method:string match_score:double"
    ),
    "time_series_folds": "brand:string fold:bigint week:date role:string",
    "holdout_split": "brand:string codigo_padre:string centro:string week:date is_holdout:boolean",
    "classification_metrics": "brand:string n:bigint precision:double recall:double f1:double",
    "regression_metrics": "brand:string n:bigint mae:double rmse:double r2:double",
    "store_profiles": (
        "centro:string avg_velocity:double std_velocity:double avg_discount:double avg_price:double n_skus:bigint "
        "pct_discounted:double avg_stock:double avg_woc:double"
    ),
    "store_clusters": (
        "centro:string avg_velocity:double std_velocity:double avg_discount:double avg_price:double n_skus:bigint "
        "pct_discounted:double avg_stock:double avg_woc:double cluster:bigint silhouette:double"
    ),
    "model_scores": (
        "brand:string codigo_padre:string centro:string week:date class_label:double depth_label:double "
        "markdown_probability:double raw_depth:double"
    ),
    "feature_importance": "brand:string feature:string importance:double",
    "permutation_importance": "brand:string feature:string auc:double importance:double",
    "ranking_metrics": "brand:string n:bigint positives:bigint auc:double avg_precision:double",
    "model_metrics": "brand:string task:string metric:string value:double",
    "model_folds": "brand:string fold:int task:string metric:string value:double",
    "model_comparison": "brand:string model:string task:string metric:string value:double",
    "match_names": "brand:string codigo_padre:string competitor:string offer_id:string match_method:string match_score:double",
    "channel_planner_queue": "brand:string week:date parent_sku:string channel:string key:string bm_status:string manual_price:double",
    "channel_planner_roster": "brand:string name:string n:bigint rev_delta:bigint",
    "channel_export_rows": (
        "brand:string week:date parent_sku:string channel:string status:string recommended_price:bigint margin_pct:double "
        "expected_velocity:double section:string"
    ),
    "stream_weekly_sales": (
        "brand:string sku:string centro:string week:date units_sold:bigint gross_revenue:double "
        "click_collect_units:bigint"
    ),
    "stream_weekly_folios": "brand:string sku:string centro:string week:date txn_count:bigint",
    "stream_traffic_weekly": (
        "centro:string week:date weekly_entries:bigint weekly_exits:bigint avg_dwell_time:double"
    ),
    "stream_audit_counts": "brand:string action:string week:date n:bigint",
}
