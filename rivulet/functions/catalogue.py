"""Finding a scalar function by its name in the surveyed language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

import rivulet.functions as own
from rivulet.functions._args import col, value

# The names of the language's scalar functions, by kind.
NAMES = {
    "math": (
        "abs ceil ceiling conv crc32 e exp expm1 floor ln log log10 log2 pi pow power rand rint round sign signum sinh sqrt cbrt truncate "
        "acos asin atan atan2 cos cosh cot degrees radians sin tan mod"
    ),
    "arithmetic": "add subtract multiply divide modulus",
    "cryptography": "md5 sha1 sha2",
    "date and time": (
        "adddate date datediff date_add date_format date_sub day dayofmonth day_of_month dayofweek day_of_week dayofyear day_of_year extract "
        "from_unixtime hour hour_of_day last_day make_date makedate minute minute_of_hour month month_of_year monthname quarter second "
        "second_of_minute subdate timestamp timestampadd timestampdiff utc_timestamp current_timezone unix_timestamp week weekday "
        "weekofyear week_of_year year now curdate current_date localtime current_timestamp localtimestamp sysdate relative_timestamp "
        "earliest latest"
    ),
    "text": "ascii concat concat_ws left length locate lower ltrim position regexp replace reverse right rtrim strcmp substr substring trim upper like tostring",
    "json": "json json_object json_array json_array_length to_json_string json_extract json_keys json_valid json_delete json_set json_append json_extend",
    "collection": "array array_length forall exists filter transform reduce",
    "condition": "isnull isnotnull ifnull if nullif ispresent isempty isblank coalesce typeof",
    "ip": "cidrmatch is_ipv4 ip_to_int",
}
# Names under which Spark's API has a function of another name.
_ELSEWHERE = {"date": "to_date", "timestamp": "to_timestamp", "localtime": "localtimestamp"}


def function(name: str) -> Callable:
    """This package's function of the name, or Spark's; names do not depend on case."""
    name = name.lower()
    if not any(name in names.split() for names in NAMES.values()):
        raise ValueError(f"{name} is not a function of the language")
    if name in own.__all__:
        return getattr(own, name)
    if name == "mod":
        return own.modulus
    if name == "if":
        return lambda condition, yes, no: F.when(col(condition), value(yes)).otherwise(value(no))
    if name == "like":
        return lambda x, pattern: F.col(x).like(pattern) if isinstance(x, str) else x.like(pattern)
    return getattr(F, _ELSEWHERE.get(name, name))
