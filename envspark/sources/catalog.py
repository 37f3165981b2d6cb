"""Files listed by what their names say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Digits of the parts of a time in a template, of {run} (an hour) and of {lead}.
DIGITS = {"Y": 4, "m": 2, "d": 2, "j": 3, "H": 2, "M": 2, "S": 2}
LEAD_DIGITS = 2


def pattern(template: str) -> tuple[str, dict[str, int]]:
    """A regular expression of whole names for a template of %Y %m %d %j %H %M %S, {run} and {lead}, and the group of each part."""
    out, groups = "^", {}
    for part in re.findall(r"%.|\{run\}|\{lead\}|[^%{]+|.", template, re.S):
        name = {"{run}": "H", "{lead}": "lead"}.get(part, part[1:] if part[0] == "%" and len(part) == 2 else None)
        if name is None:
            out += "".join(c if c.isalnum() or c == "_" else "\\" + c for c in part)
        elif name in groups or name not in {*DIGITS, "lead"}:
            raise ValueError(f"{part} is {'twice' if name in groups else 'no part of a name'} in {template!r}")
        else:
            groups[name] = len(groups) + 1
            out += f"([0-9]{{{DIGITS.get(name, LEAD_DIGITS)}}})"
    if "Y" not in groups or not ({"m", "d"} <= groups.keys() or "j" in groups):
        raise ValueError(f"{template!r} names no date")
    return out + "$", groups


def excluded(name: Column, patterns: list[str]) -> Column:
    """Whether a name is one of patterns: *.ext is every name ending in .ext, a pattern starting with a dot every hidden name, else the name itself."""
    out = F.lit(False)
    for p in patterns:
        out |= name.endswith(p[1:]) if p.startswith("*.") else name.startswith(".") if p.startswith(".") else name == p
    return out


def catalog(files: DataFrame, template: str, exclude: list[str] = (), start=None, end=None, newest: int | None = None, most_bytes: int | None = None, place: str | None = None) -> DataFrame:
    """files (key, bytes, ...) with time and lead from their names (what follows the last /), one a time and lead: the greatest key; of rows with that key the one
    with the least place (a column of whole numbers, the order of the listing), which is open without place.

    Names of another form, with a time that doesn't exist, excluded ones and files of more than most_bytes are left out; start and end are times
    (timestamp without zone), both included. newest keeps the latest so many times with all their leads, counted after repeated ones went.
    Hours and smaller parts that the template lacks are 0; without {lead} lead is null. Columns named time, lead or _name are replaced.
    """
    regex, groups = pattern(template)
    name = F.element_at(F.split("key", "/"), -1)
    number = lambda part: F.regexp_extract("_name", regex, groups[part]).cast("int") if part in groups else F.lit(0)
    named = files.drop("time", "lead", "_name").withColumn("_name", name).filter(F.col("_name").rlike(regex) & ~excluded(F.col("_name"), list(exclude)))
    if most_bytes is not None:
        named = named.filter(F.col("bytes") <= most_bytes)
    if "j" in groups:
        first = F.make_date(number("Y"), F.lit(1), F.lit(1))
        day = F.date_add(first, number("j") - 1)
        day = F.when((number("j") > 0) & (F.year(day) == F.year(first)), day)
        date = [F.year(day), F.month(day), F.dayofmonth(day)]
    else:
        date = [number("Y"), number("m"), number("d")]
    read = named.withColumns({f"_{k}": v for k, v in zip("ymdhis", [*date, number("H"), number("M"), number("S")])})
    read = read.withColumn("time", F.expr("try_make_timestamp_ntz(_y, _m, _d, _h, _i, _s)")).withColumn("lead", number("lead") if "lead" in groups else F.lit(None).cast("int"))
    read = read.filter("time is not null").drop("_name", *[f"_{k}" for k in "ymdhis"])
    for bound, on in ((start, lambda t: F.col("time") >= t), (end, lambda t: F.col("time") <= t)):
        if bound is not None:
            read = read.filter(on(F.lit(bound).cast("timestamp_ntz")))
    rest = [c for c in read.columns if c not in ("time", "lead")]
    one = read.groupBy("time", "lead").agg(F.max_by(F.struct(*rest), F.struct("key", F.negative(place)) if place else F.col("key")).alias("f")).select("time", "lead", "f.*")
    if newest is None:
        return one
    latest = one.select("time").distinct().orderBy(F.desc("time")).limit(newest)
    return one.join(latest, "time", "left_semi")
