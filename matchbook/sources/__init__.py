from matchbook.sources.tables import (
    LISTING_SCHEMA,
    MATCH_SCHEMA,
    PLAYER_SCHEMA,
    TOURNAMENT_SCHEMA,
    match_fact,
    player_dim,
    read_csv_table,
    read_parquet_table,
    tournament_dim,
)

__all__ = [
    "LISTING_SCHEMA",
    "MATCH_SCHEMA",
    "PLAYER_SCHEMA",
    "TOURNAMENT_SCHEMA",
    "match_fact",
    "player_dim",
    "read_csv_table",
    "read_parquet_table",
    "tournament_dim",
]
