"""Label names to classes, distances and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label folders, the distance in metres they stand for, and class names.
NO_MOTION = "label_00"
DISTANCE = {"label_00": 0, "label_01": 1, "label_02": 2, "label_03": 3}
BINARY_NAMES = {0: "no_motion", 1: "motion"}
STATIC_ACTIVITIES = ["nopeople", "standing"]
MACRO_ACTIVITIES = ["jump", "punching", "pushpull", "squatting", "twist", "waving"]


def binary_class(label: Column) -> Column:
    return F.when(label == NO_MOTION, 0).otherwise(1)


def binary_name(label_class: Column) -> Column:
    return F.when(label_class == 0, BINARY_NAMES[0]).otherwise(BINARY_NAMES[1])


def distance(label: Column) -> Column:
    """Distance class; an unknown label fails the query and is named in the error."""
    out = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))).cast("int")
    for name, metres in DISTANCE.items():
        out = F.when(label == name, metres).otherwise(out)
    return out


def activity_class(activity: Column) -> Column:
    """0 for static, 1 for large movements; any other activity fails the query."""
    return (
        F.when(activity.isin(STATIC_ACTIVITIES), 0)
        .when(activity.isin(MACRO_ACTIVITIES), 1)
        .otherwise(F.raise_error(F.concat(F.lit("activity has no binary class: "), activity)).cast("int"))
    )


def class_name(label_class: Column, names: dict[int, str]) -> Column:
    """Name of a class, ``class_<n>`` when it has none."""
    out = F.concat(F.lit("class_"), label_class.cast("string"))
    for number, name in names.items():
        out = F.when(label_class == number, name).otherwise(out)
    return out
