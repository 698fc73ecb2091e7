"""Column functions over the names of downloaded files (``<word>_YYYY-MM-DD_<rest>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a file name carries its date.
DATED_NAME = r"^\w+_(\d{4}-\d{2}-\d{2})_"


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def name_date(name: Column) -> Column:
    """Date in a file name; names of another form fail."""
    wrong = F.raise_error(F.concat(F.lit("Expecting a filename containing an ISO date: "), name)).cast("date")
    # The name is looked at once for each row, also in the filters that joins on the date push to the scan.
    found = F.array(F.regexp_extract(name, DATED_NAME, 1))
    return F.get(F.transform(found, lambda date: F.when(date != "", F.to_date(date)).otherwise(wrong)), F.lit(0))


def path_name(path: Column) -> Column:
    """Name of the downloaded file: the last component of a path, or the folder above a part that Spark wrote.

    In a partition folder (``file=<name>``) the name is what follows the sign.
    """
    # Evaluated for every row of a scan: looked for from the end, where splitting takes many times as long.
    last = F.substring_index(path, "/", -1)
    above = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    own = F.when(last.startswith("part-"), above).otherwise(last)
    return F.regexp_replace(own, "^[A-Za-z_]+=", "")


def path_date(path: Column) -> Column:
    """Date in the file's own name; dates in folders above it don't count, and a name without one fails."""
    return name_date(path_name(path))


def path_place(path: Column) -> Column:
    """Where the downloaded file is: its path, or that of the folder of the parts that Spark wrote."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.startswith("part-"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)
