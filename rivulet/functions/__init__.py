"""Scalar functions that differ from Spark's, or that Spark lacks; all others are Spark's own of the same name."""

from rivulet.functions.conditions import isblank, isempty, ispresent, xor
from rivulet.functions.dates import (
    adddate,
    date_add,
    date_sub,
    day_of_month,
    day_of_week,
    day_of_year,
    dayname,
    earliest,
    hour_of_day,
    interval,
    latest,
    makedate,
    minute_of_hour,
    month_of_year,
    monthname,
    relative_timestamp,
    second_of_minute,
    subdate,
    sysdate,
    timestampadd,
    timestampdiff,
    utc_timestamp,
    week,
    week_of_year,
)
from rivulet.functions.ip import cidrmatch, ip_to_int, is_ipv4
from rivulet.functions.json import (
    json,
    json_append,
    json_array,
    json_array_length,
    json_delete,
    json_extend,
    json_extract,
    json_keys,
    json_object,
    json_set,
    json_valid,
    to_json_string,
)
from rivulet.functions.values import add, array_length, cast, divide, modulus, multiply, strcmp, subtract, tostring, truncate

__all__ = [
    "add", "adddate", "array_length", "cast", "cidrmatch", "date_add", "date_sub", "day_of_month", "day_of_week", "day_of_year",
    "dayname", "divide", "earliest", "hour_of_day", "interval", "ip_to_int", "is_ipv4", "isblank", "isempty", "ispresent", "json",
    "json_append", "json_array", "json_array_length", "json_delete", "json_extend", "json_extract", "json_keys", "json_object",
    "json_set", "json_valid", "latest", "makedate", "minute_of_hour", "modulus", "month_of_year", "monthname", "multiply",
    "relative_timestamp", "second_of_minute", "strcmp", "subdate", "subtract", "sysdate", "timestampadd", "timestampdiff",
    "to_json_string", "tostring", "truncate", "utc_timestamp", "week", "week_of_year", "xor",
]
