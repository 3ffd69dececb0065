"""Explicit schemas of the tables that are read from text formats."""

SPENDING = "territory_id long, category string, date string, value double"
PERIODIC = "period string, name string, value double"
LABELS = "channel string, msg_id long, row int, place_ok string, type_ok string, comment string"
EXPORT = "messages array<struct<id: long, type: string, date_unixtime: string, text_entities: array<struct<type: string, text: string>>>>"
PLACES = "is_incident boolean, event_type string, severity int, in_russia boolean, places array<struct<settlement: string, district: string, city: string, region: string>>"
POINTS = "territory_id long, lat double, lon double"
WEATHER = "territory_id int, month date, t2m_c double, t2m_c_anom double, precip_mm_day_anom double, snowfall_mm_day_anom double, wind_ms_anom double"
