"""Cleaning steps as DataFrame -> DataFrame functions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.columns import fix_label_encoding as _fix_label
from ..functions.columns import inf_to_null

# Capture file -> weekday.  The first eight are fixed values: the names that the public capture
# gives its files.  The last two are ours, for a table that has flows on every day.
FILE_TO_DAY = {
    "Monday-WorkingHours.pcap_ISCX.csv": "Monday",
    "Tuesday-WorkingHours.pcap_ISCX.csv": "Tuesday",
    "Wednesday-workingHours.pcap_ISCX.csv": "Wednesday",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv": "Thursday",
    "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv": "Thursday",
    "Friday-WorkingHours-Morning.pcap_ISCX.csv": "Friday",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv": "Friday",
    "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv": "Friday",
    "Saturday-WorkingHours.pcap_ISCX.csv": "Saturday",
    "Sunday-WorkingHours.pcap_ISCX.csv": "Sunday",
}


def drop_blank_rows(df: DataFrame, label_col: str = "label",
                    keep_cols: tuple = ("source_file", "capture_pos")) -> DataFrame:
    """Drop rows whose every column except the label (and provenance) is NULL/NaN."""
    subset = [c for c in df.columns if c != label_col and c not in keep_cols]
    return df.dropna(how="all", subset=subset)


def fix_label_encoding(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.withColumn(label_col, _fix_label(label_col))


def coerce_inf(df: DataFrame) -> DataFrame:
    """+-Inf and NaN -> NULL in every floating column; other columns untouched."""
    cols = [inf_to_null(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def tag_source_day(df: DataFrame, file_col: str = "source_file", out: str = "day",
                   mapping: dict | None = None) -> DataFrame:
    """Weekday from the capture file name via a literal map; an unknown file fails the job
    (``raise_error``), as a dictionary lookup would."""
    mapping = mapping or FILE_TO_DAY
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    day = F.try_element_at(m, F.col(file_col))
    return df.withColumn(out, F.when(day.isNull(),
                                     F.raise_error(F.concat(F.lit("unknown source file: "),
                                                            F.coalesce(F.col(file_col), F.lit("NULL")))))
                         .otherwise(day))


def clean_flows(raw: DataFrame) -> DataFrame:
    """Blank rows out, label fixed, Inf/NaN to NULL, weekday from the file name."""
    return tag_source_day(coerce_inf(fix_label_encoding(drop_blank_rows(raw))))
