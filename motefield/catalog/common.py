"""Small helpers shared by the query catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(column: str | Column, name: str | None = None) -> Column:
    """Round to six places, the precision at which results are compared."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Round every double column that is not a key."""
    out = []
    for field in df.schema.fields:
        plain = field.name in keys or field.dataType.simpleString() != "double"
        out.append(F.col(field.name) if plain else r6(field.name))
    return df.select(*out)


def sql_split(groups: str, group: str, strata: str | None, name: str, share: str = "0.2", seed: int = 42) -> str:
    """SQL for the stratified split of ``splits.stratified_split``."""
    part = f"partition by {strata} " if strata else ""
    cols = f"{group}, {strata}" if strata else group
    over = f"({part}order by md5(cast({group} as varchar)||':{seed}'), {group})"
    total = f"over ({part.strip()})"
    return f"""{name} as (
  select {cols}, case when row_number() over {over} <= ceil({share}::double*count(*) {total}) then 'test' else 'train' end as role
  from (select distinct {cols} from {groups}))"""
