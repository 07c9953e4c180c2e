"""Declared schemas of the data model; canonical data are never inferred."""

BAR = "ts timestamp, open double, high double, low double, close double, vwap double, volume double, count bigint"
TICK = "ts timestamp, price double, volume double, side string"
BOOK = "ts timestamp, symbol string, type string, side string, price double, qty double, checksum bigint"
TRADE = "ts timestamp, symbol string, side string, price double, qty double, ord_type string, trade_id bigint"
LIQUIDATION = "ts timestamp, symbol string, side string, price double, orig_qty double, avg_price double, order_status string, event_id string"
BUCKET = "ts timestamp, symbol string, long_usd double, short_usd double, event_id string"
FUNDING = "ts timestamp, funding_rate double, interval_hours int"
MINUTE = "ts_s bigint, open double, high double, low double, close double, volume double, trades bigint"
LEDGER = "txid string, refid string, time string, type string, subtype string, aclass string, asset string, wallet string, amount string, fee string, balance string, seq bigint"
