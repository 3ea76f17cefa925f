"""Column layouts of the canonical tables and of the landed feeds."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T
from pyspark.sql import Column, DataFrame

QUOTE_SCHEMA = T.StructType([
    T.StructField("bookmaker", T.StringType()),
    T.StructField("sport", T.StringType()),
    T.StructField("competition", T.StringType()),
    T.StructField("match_id", T.StringType()),
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("market_type", T.StringType()),
    T.StructField("n_outcomes", T.IntegerType()),
    T.StructField("selection", T.StringType()),
    T.StructField("line", T.DoubleType()),
    T.StructField("team_scope", T.StringType()),
    T.StructField("odds", T.DoubleType()),
    T.StructField("url", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    # Stands in for list order: ties between equal prices take the lowest.
    T.StructField("ingest_seq", T.LongType()),
])
QUOTE_COLUMNS = [f.name for f in QUOTE_SCHEMA.fields]

# Columns that identify one market of one match. NULL keys are equal.
MARKET_KEYS = ["match_id", "market_type", "line", "team_scope"]

LEG_TYPE = T.StructType([
    T.StructField("bookmaker", T.StringType()),
    T.StructField("selection", T.StringType()),
    T.StructField("odds", T.DoubleType()),
    T.StructField("url", T.StringType()),
    T.StructField("event_label", T.StringType()),
    T.StructField("stake", T.DoubleType()),
])

MAPPING_TYPE = T.StructType([
    T.StructField("market_type", T.StringType()),
    T.StructField("selection", T.StringType()),
    T.StructField("n_outcomes", T.IntegerType()),
    T.StructField("line", T.DoubleType()),
    T.StructField("team_scope", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

# Landed feed payloads: only the fields the jobs read are declared.
LINE_FEED = (
    "struct<Value:array<struct<I:bigint,O1:string,O2:string,L:string,S:bigint,"
    "E:array<struct<G:int,T:int,C:double,P:double>>>>>"
)
TREE_FEED = (
    "struct<sport:map<string,struct<competition:map<string,struct<name:string,"
    "game:map<string,struct<id:bigint,team1_name:string,team2_name:string,start_ts:bigint,"
    "market:map<string,struct<type:string,event:map<string,struct<type:string,name:string,"
    "price:double>>>>>>>>>>>"
)
GROUPED_FEED = (
    "map<string,array<struct<trn:string,ctn:string,events:array<struct<id:string,nm:string,"
    "cms:array<string>,tm:string,mr:map<string,struct<tp:int,pn:string,nm:string,vl:string,"
    "ou:array<map<string,struct<nm:string,kf:double,vl:string>>>>>>>>>>"
)
STAT_MAIN = "struct<SG:array<struct<TG:string,I:bigint>>>"
STAT_SUB = "struct<E:array<struct<G:int,T:int,P:double,C:double>>>"

HISTORY_COLUMNS = [
    "date_detection", "match", "sport", "match_date", "n_issues",
    "bookmaker_a", "event_a", "cote_a", "mise_a", "url_a",
    "bookmaker_b", "event_b", "cote_b", "mise_b", "url_b",
    "bookmaker_c", "event_c", "cote_c", "mise_c", "url_c",
    "marge_m", "roi_pct", "profit", "init_balance", "final_balance",
    "score_ia", "explanation", "statut",
]


def as_quotes(df: DataFrame) -> DataFrame:
    """Project and cast onto the canonical quote layout, absent columns NULL."""
    have = set(df.columns)
    cols: list[Column] = []
    for field in QUOTE_SCHEMA.fields:
        source = F.col(field.name) if field.name in have else F.lit(None)
        cols.append(source.cast(field.dataType).alias(field.name))
    return df.select(*cols)
