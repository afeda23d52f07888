"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.sources.tables import view_sql

NUMBERS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "dirty_customer": ["c_custkey", "acctbal", "nation", "nation_copy", "const_col", "mostly_null", "label"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
}
TEXTS = {
    "lineitem": ["l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["ts", "event_type", "props"],
    "customer": ["c_name", "c_mktsegment"],
    "dirty_customer": ["segment", "near_const", "num_text", "flag_text", "date_text"],
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def with_view(name: str, body: str) -> str:
    """SQL over one of the derived views."""
    return f"WITH {name} AS ({view_sql(name)})\n{body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {name} AS ({view_sql(name)}),\n{body.lstrip()[5:]}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
