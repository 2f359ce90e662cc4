"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()
_DATE, _TS, _B = T.DateType(), T.TimestampNTZType(), T.BooleanType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LEVELS = _struct(
    dam=_S, obs_datetime=_TS, rwl_m=_D, dev_24h_m=_D, nhwl_m=_D, dev_nhwl_m=_D,
    rule_curve_m=_D, dev_rule_curve_m=_D, gates=_D, gate_opening_m=_D,
    inflow_cms=_D, outflow_cms=_D, scraped_at=_TS, source=_S,
)
ALERTS = _struct(basin=_S, status=_S, on_watch=_B, kind=_S, date=_DATE, scraped_at=_TS)
WEATHER = _struct(
    dam=_S, date=_DATE, precipitation_sum=_D, temperature_2m_mean=_D,
    temperature_2m_max=_D, relative_humidity_2m_mean=_D,
    et0_fao_evapotranspiration=_D, source=_S, n_points=_I,
)
RAIN_FORECAST = _struct(dam=_S, date=_DATE, lead=_I, rain_mm=_D)
LEDGER = _struct(
    issue_date=_DATE, target_date=_DATE, dam=_S, horizon=_I, issue_rwl_m=_D,
    pred_delta=_D, features=T.MapType(_S, _D), baseline_inputs=T.MapType(_S, _D),
)
ERROR_LOG = _struct(
    issue_date=_DATE, target_date=_DATE, dam=_S, horizon=_I, pred_delta=_D,
    actual_delta=_D, abs_err_model=_D, abs_err_persistence=_D, abs_err_drift=_D,
)
DRIFT_LOG = _struct(detected_at=_DATE, dam=_S, horizon=_I, abs_err=_D)
# Sums of cross products, one row per cell: the state of the live learner.
SUMS = _struct(pool=_S, cell=_I, part=_D)
REGISTRY = _struct(dam=_S, lat=_D, lon=_D, basin=_S)

LEVEL_KEY = ("dam", "obs_datetime")
ALERT_KEY = ("basin", "date")
WEATHER_KEY = ("dam", "date")
RAIN_KEY = ("dam", "date", "lead")
LEDGER_KEY = ("dam", "issue_date", "horizon")
