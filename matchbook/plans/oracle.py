"""The same queries as plain SQL over the same tables, to check results by.

Each statement is written from the meaning of the query and shares no code with
its Spark form. Queries that train a forest have no statement here.
"""

from __future__ import annotations

from matchbook.plans import season, warehouse
from matchbook.plans.registry import EVENT, TITLE_YEAR

_EVENT_FILTER = f"lower(tournament) = '{EVENT[0].lower()}' and year = {EVENT[1]}"

_LINE_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
_IMPORTANT = "('Grand Slam', 'Masters 1000', 'ATP 500')"

_TOUR = f"""
v as (
  select c_custkey as id, c_name as name, n_name as country
  from customer left join nation on n_nationkey = c_nationkey
  union all
  select -s_suppkey - 1, s_name, n_name
  from supplier left join nation on n_nationkey = s_nationkey
),
e as (
  select {_LINE_KEY} as match_id,
    case when l_returnflag = 'R' then o_custkey else -l_suppkey - 1 end as src,
    case when l_returnflag = 'R' then -l_suppkey - 1 else o_custkey end as dst,
    case when l_quantity >= 50 then 'F' when l_quantity >= 46 then 'S'
         when l_linestatus = 'O' then 'G1' else 'G2' end as match_type,
    case when l_quantity >= 50 then 11 when l_quantity >= 46 then 5 else 1 end as points,
    1 as head2head
  from lineitem join orders on l_orderkey = o_orderkey
)
"""

_PLAYERS = """
raw_players as (
  select 'C' || c_custkey as player_id,
    case when c_mktsegment <> 'MACHINERY' then c_mktsegment end as first_name,
    c_name as last_name, c_nationkey as nk, c_mktsegment as residence,
    c_custkey as num, c_acctbal as balance
  from customer
  union all
  select 'S' || s_suppkey, 'Supplier', s_name, s_nationkey, null, s_suppkey, s_acctbal
  from supplier
),
players as (
  select *,
    case when balance >= 0 then date '1960-01-01' + cast(num % 15000 as integer) end as born,
    case when first_name is null then last_name else first_name || ' ' || last_name end
      as full_name
  from raw_players left join nation on n_nationkey = nk
)
"""

_EDGES = f"""
edges as (
  select {_LINE_KEY} as match_id,
    case when l_returnflag = 'R' then 'C' || o_custkey else 'S' || l_suppkey end as src,
    case when l_returnflag = 'R' then 'S' || l_suppkey else 'C' || o_custkey end as dst,
    substr(o_orderpriority, 3) || ' ' || strftime(o_orderdate, '%m-%d') as tournament,
    case when l_quantity >= 50 then 'Finals' when l_quantity >= 46 then 'Semi-Finals'
         else 'Round Robin Day ' || l_linenumber end as round,
    l_linenumber as round_order,
    cast(l_quantity as integer) || '-' || l_linenumber as match_score,
    cast(year(o_orderdate) as integer) as year
  from lineitem join orders on l_orderkey = o_orderkey
  where year(o_orderdate) between {warehouse.FIRST_YEAR} and {warehouse.LAST_YEAR}
    and not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')
),
vertices as (
  select player_id as id, first_name, last_name, n_name as nationality, full_name from players
)
"""

_SEASON = f"{_PLAYERS}, {_EDGES}"

_TITLES = """
tournaments as (
  select o_orderkey as tourn_id,
    substr(o_orderpriority, 3) || ' ' || strftime(o_orderdate, '%m-%d') as tourn_name,
    case when o_totalprice >= 490000 then 'Grand Slam'
         when o_totalprice >= 475000 then 'Masters 1000'
         when o_totalprice >= 450000 then 'ATP 500' else 'ATP 250' end as tourn_type,
    cast(year(o_orderdate) as integer) as tourn_start_year,
    case when o_orderstatus <> 'P' then 'C' || o_custkey end as winner_id,
    case when o_orderstatus <> 'P' then c_name end as tourn_winner
  from orders left join customer on c_custkey = o_custkey
)
"""

_WON = f"""
{_TITLES},
won as (
  select *, case tourn_type when 'Grand Slam' then 100 when 'Masters 1000' then 50
                            when 'ATP 500' then 25 else 0 end as points
  from tournaments
  where tourn_start_year = {TITLE_YEAR} and tourn_type in {_IMPORTANT}
    and winner_id is not null and tourn_winner is not null
),
best as (
  select winner_id, tourn_winner, cast(sum(points) as bigint) as total_points
  from won group by all order by total_points desc, winner_id limit 10
),
top_points as (
  select *, cast(row_number() over (order by total_points desc, winner_id) as integer) as rank
  from best
)
"""

# Both directions of the round-robin meetings, then all ids in reach of each id.
_GROUPS = f"""
{_SEASON},
rr as materialized (
  select lower(tournament) as tournament, year, src, dst from edges where round like 'Round Robin%'
),
meet as materialized (
  select distinct tournament, year, src as a, dst as b from rr
  union
  select distinct tournament, year, dst, src from rr
),
reach(tournament, year, id, other) as (
  select tournament, year, a, a from meet
  union
  select r.tournament, r.year, r.id, m.b
  from reach r join meet m
    on m.tournament = r.tournament and m.year = r.year and m.a = r.other
),
groups as (
  select tournament, year, id, min(other) as group_id from reach group by tournament, year, id
),
wins as (
  select tournament, year, src as id, cast(count(*) as bigint) as wins
  from rr group by tournament, year, src
),
grouped as (
  select g.tournament, g.year, g.id, g.group_id, v.full_name, v.nationality
  from groups g join vertices v on v.id = g.id
)
"""

_RAW_LISTINGS = """
raw_listings as (
  select l_suppkey || '_' || l_orderkey || '-' || l_partkey || '-' || l_linenumber as id,
    case when p_brand not in ('Brand#13', 'Brand#14') then p_brand end as neighbourhood,
    case when not (p_type = 'PROMO' and l_linenumber = 7) then p_type end as room_type,
    case when l_quantity = 17 or l_quantity = 13 or l_quantity = 19 then null
         else floor(l_extendedprice / 100) end as price,
    case when p_size = 50 then 0.0 else p_size end as latitude,
    p_retailprice as longitude,
    case when l_linenumber < 7 then cast(l_linenumber as double) end as minimum_nights,
    case when l_tax = 0 then 0 when l_tax = 0.08 then null
         else cast(l_quantity as integer) end as number_of_reviews,
    l_tax as reviews_per_month,
    case when p_size % 10 = 0 then 1.0 else cast(p_size % 10 as double) end
      as calculated_host_listings_count,
    case when l_discount = 0.1 then 0.0 else round(l_discount * 100) end as availability_365
  from lineitem join part on p_partkey = l_partkey
),
kept as (
  select * from raw_listings
  where price between 10 and 1000 and neighbourhood is not null and room_type is not null
),
listings as (
  select id, neighbourhood, room_type, ln(price) as label, latitude, longitude, minimum_nights,
    number_of_reviews, reviews_per_month, calculated_host_listings_count, availability_365,
    case when availability_365 > 0 then number_of_reviews / availability_365 else 0.0 end
      as reviews_per_availability,
    case when number_of_reviews > 0 then 1.0 else 0.0 end as has_reviews,
    ln(1 + minimum_nights) as log_minimum_nights,
    ln(1 + availability_365) as log_availability
  from kept
),
bucketed as (
  select *,
    cast(('0x' || substr(md5(id), 1, 8))::ubigint % 100 as integer) as bucket,
    cast(('0x' || substr(md5(id), 9, 8))::ubigint % 5 as integer) as fold
  from listings
)
"""

_INDEXED = f"""
{_RAW_LISTINGS},
by_neighbourhood as (
  select neighbourhood, row_number() over (order by count(*) desc, neighbourhood) - 1 as i
  from listings group by neighbourhood
),
by_room_type as (
  select room_type, row_number() over (order by count(*) desc, room_type) - 1 as i
  from listings group by room_type
),
indexed as (
  select l.*, n.i as ni, r.i as ri
  from listings l join by_neighbourhood n using (neighbourhood) join by_room_type r using (room_type)
)
"""

_LINEAR = f"""
{_RAW_LISTINGS},
usable as (
  select *, coalesce(number_of_reviews, (
    select avg(number_of_reviews) from bucketed where bucket < 80)) as n
  from bucketed
),
line as (
  select regr_slope(label, n) as slope, regr_intercept(label, n) as intercept
  from usable where bucket < 80
),
scored as (
  select id, label as y, intercept + slope * n as p from usable, line where bucket >= 80
)
"""


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes.strip()}\n{body.strip()}"


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(cast({expression} as double), {digits}) as {name}"


_IMPUTED_ROUNDED = ", ".join(
    [
        _r(f"coalesce({c}, avg({c}) over ())", f"{c}_imp")
        for c in (
            "latitude longitude minimum_nights reviews_per_month calculated_host_listings_count "
            "availability_365 reviews_per_availability has_reviews log_minimum_nights "
            "log_availability"
        ).split()
    ]
    + [
        "cast(coalesce(number_of_reviews, trunc(avg(number_of_reviews) over ())) as integer) "
        "as number_of_reviews_imp"
    ]
)

_ASSEMBLED = ", ".join(
    [
        _r(f"coalesce({c}, avg({c}) over ())", f"f_{c}")
        for c in (
            "latitude longitude log_minimum_nights reviews_per_month "
            "calculated_host_listings_count log_availability reviews_per_availability "
            "has_reviews"
        ).split()
    ]
    + [
        "cast(coalesce(number_of_reviews, trunc(avg(number_of_reviews) over ())) as double) "
        "as f_number_of_reviews"
    ]
)


def _summary(value: str, source: str) -> str:
    return f"""
select {_r(f'min({value})', 'min_value', 4)}, {_r(f'max({value})', 'max_value', 4)},
  {_r(f'avg({value})', 'mean_value', 4)}, {_r(f'stddev_samp({value})', 'stddev_value', 4)}
from {source}"""


def _describe() -> str:
    numbers = (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
    ).split()
    rows = [
        f"select '{c}' as column_name, cast(count({c}) as bigint) as n, "
        f"{_r(f'avg({c})', 'mean', 4)}, {_r(f'stddev_samp({c})', 'stddev', 4)}, "
        f"{_r(f'min({c})', 'min_number', 4)}, {_r(f'max({c})', 'max_number', 4)}, "
        "cast(null as varchar) as min_text, cast(null as varchar) as max_text from lineitem"
        for c in numbers
    ] + [
        f"select '{c}', cast(count({c}) as bigint), null, null, null, null, min({c}), max({c}) "
        "from lineitem"
        for c in ("l_returnflag", "l_linestatus")
    ]
    return "\nunion all\n".join(rows)


def _describe_rows(numbers: str, texts: str) -> str:
    """Rows of a description of ``t``."""
    rows = [
        f" select '{c}' as column_name, cast(count({c}) as bigint) as n, "
        f"{_r(f'avg({c})', 'mean', 4)}, {_r(f'stddev_samp({c})', 'stddev', 4)}, "
        f"{_r(f'min({c})', 'min_number', 4)}, {_r(f'max({c})', 'max_number', 4)}, "
        "cast(null as varchar) as min_text, cast(null as varchar) as max_text from t"
        for c in numbers.split()
    ] + [
        f"select '{c}', cast(count({c}) as bigint), null, null, null, null, "
        f"min({c}::varchar), max({c}::varchar) from t"
        for c in texts.split()
    ]
    return "\nunion all\n".join(rows)


_LISTING_COLUMNS = (
    "id host_id neighbourhood_group neighbourhood room_type latitude longitude price "
    "minimum_nights number_of_reviews reviews_per_month calculated_host_listings_count "
    "availability_365"
)
_LISTING_TEXT = """
select concat_ws('-', l_orderkey, l_partkey, l_linenumber) as id, l_suppkey::bigint as host_id,
  l_linestatus as neighbourhood_group,
  case p_brand when 'Brand#13' then null when 'Brand#14' then '' else p_brand end as neighbourhood,
  case when p_type = 'PROMO' and l_linenumber = 7 then '' else p_type end as room_type,
  nullif(p_size, 50)::integer as latitude, p_retailprice as longitude,
  case l_quantity when 13 then '' when 17 then '1.2.3' when 19 then null
    else '$' || floor(l_extendedprice / 100)::bigint end as price,
  nullif(l_linenumber, 7)::integer as minimum_nights,
  case when l_tax = 0 then null when l_tax = 0.08 then 'n/a'
    else l_quantity::integer::varchar end as number_of_reviews,
  case when l_tax <> 0 then l_tax end as reviews_per_month,
  nullif(p_size % 10, 0)::integer as calculated_host_listings_count,
  case when l_discount <> 0.1 then round(l_discount * 100)::integer end as availability_365
from lineitem join part on p_partkey = l_partkey"""

_MATCH_COLUMNS = (
    "match_id tourn_id tourn_name tourn_place tourn_round tourn_round_order winner_id loser_id "
    "winner_seed loser_seed match_score winner_sets loser_sets winner_games loser_games "
    "winner_tiebreaks_won loser_tiebreaks_won tourn_currency tourn_value tourn_start_date "
    "tourn_end_date"
)


def _types(columns: str) -> str:
    """The narrowest type that reads every value of each column of ``t``."""
    rows = []
    for c in columns.split():
        v = f"nullif(trim({c}::varchar), '')"
        whole = f"regexp_full_match({v}, '[+-]?[0-9]+')"
        number = f"regexp_full_match({v}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
        given = f"filter (where {v} is not null)"
        rows.append(
            f" select '{c}' as column_name, cast(count({v}) as bigint) as n_values, "
            f"cast(count(*) - count({v}) as bigint) as n_missing, case "
            f"when bool_and(lower({v}) in ('true', 'false')) {given} then 'boolean' "
            f"when bool_and({whole} and try_cast({v} as integer) is not null) {given} then 'int' "
            f"when bool_and({whole} and try_cast({v} as bigint) is not null) {given} then 'bigint' "
            f"when bool_and({number}) {given} then 'double' "
            f"when bool_and(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
            f"and try_cast({v} as date) is not null) {given} then 'date' "
            "else 'string' end as data_type from t"
        )
    return "\nunion all\n".join(rows)


def _labels() -> str:
    """Labels of three columns of the raw listings by their frequency."""
    rows = [
        f" select '{c}' as column_name, label, n, "
        "row_number() over (order by n desc, label) - 1 as label_index "
        f"from (select {c}::varchar as label, cast(count(*) as bigint) as n from t "
        f"where {c} is not null group by label)"
        for c in ("host_id", "neighbourhood", "room_type")
    ]
    return f"with t as ({_LISTING_TEXT})" + "\nunion all\n".join(rows)


def _census() -> str:
    missing = {
        "id": "false",
        "host_id": "false",
        "neighbourhood_group": "false",
        "neighbourhood": "p_brand in ('Brand#13', 'Brand#14')",
        "room_type": "p_type = 'PROMO' and l_linenumber = 7",
        "latitude": "p_size = 50",
        "longitude": "false",
        "price": "l_quantity in (13, 19)",
        "minimum_nights": "l_linenumber = 7",
        "number_of_reviews": "l_tax = 0",
        "reviews_per_month": "l_tax = 0",
        "calculated_host_listings_count": "p_size % 10 = 0",
        "availability_365": "l_discount = 0.1",
    }
    return "\nunion all\n".join(
        f"select '{c}' as column_name, 'string' as data_type, "
        f"cast(count(*) filter (where {rule}) as bigint) as n_missing "
        "from lineitem join part on p_partkey = l_partkey"
        for c, rule in missing.items()
    )


_FLOW = """
weighted as (select dst as src, src as dst, cast(count(*) as double) as w from e group by all),
flow as materialized (
  select src, dst, w / sum(w) over (partition by src) as share from weighted
)
"""

_PAGERANK_TOP = f"""
{_TOUR}, {_FLOW},
pr(step, id, rank, delta) as (
  select 0, id, 0.15::double, 0.15::double from v
  union all
  select p.step + 1, p.id, p.rank + coalesce(g.s, 0), coalesce(g.s, 0)
  from pr p left join (
    select f.dst as id, 0.85 * sum(q.delta * f.share) as s
    from pr q join flow f on f.src = q.id where q.delta > 0.001 group by f.dst
  ) g on g.id = p.id
  where exists (select 1 from pr z where z.delta > 0.001)
),
ended as (select id, rank from pr where step = (select max(step) from pr))
"""


def all_sql() -> dict[str, str]:
    raw_key = (
        "l_suppkey || '_' || l_orderkey || '-' || l_partkey || '-' || l_linenumber as id"
    )
    date_text = "strftime(born, '%Y.%m.%d')"
    important_names = (
        f"lower(tournament) in (select lower(tourn_name) from tournaments "
        f"where tourn_type in {_IMPORTANT})"
    )
    important = _with(f"{_SEASON}, {_TITLES}", f"select * from edges where {important_names}")
    event = f"select * from edges where {_EVENT_FILTER}"
    players = _with(
        _PLAYERS,
        """
select player_id, first_name, last_name, n_name as nationality, residence,
  n_name as birthplace, born as date_of_birth, nk + 1980 as turned_pro,
  cast(floor(abs(balance) / 100) as integer) as weight_kg, nk + 150 as height_cm,
  case when balance < 0 then 'Left-Handed' else 'Right-Handed' end as handedness,
  case when balance >= 0 then 'Two-Handed Backhand' end as backhand
from players""",
    )
    match_fact = f"""
select {_LINE_KEY} as match_id, o_orderkey as tourn_id,
  substr(o_orderpriority, 3) || ' ' || strftime(o_orderdate, '%m-%d') as tourn_name,
  o_orderpriority as tourn_place,
  case when not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')
       then cast(o_orderdate as date) end as tourn_start_date,
  cast(l_shipdate as date) as tourn_end_date,
  case when l_quantity >= 50 then 'Finals' when l_quantity >= 46 then 'Semi-Finals'
       else 'Round Robin Day ' || l_linenumber end as tourn_round,
  l_linenumber as tourn_round_order,
  case when l_returnflag = 'R' then 'C' || o_custkey else 'S' || l_suppkey end as source,
  case when l_returnflag = 'R' then 'S' || l_suppkey else 'C' || o_custkey end as destination,
  cast(l_quantity as integer) as source_seed, nullif(l_linenumber, 7) as destination_seed,
  case when l_quantity > 25 then 3 else 2 end as source_sets,
  l_linenumber % 2 as destination_sets,
  cast(l_quantity as integer) as source_games, l_linenumber as destination_games,
  cast(round(l_discount * 100) as integer) as source_tiebreaks_won,
  cast(round(l_tax * 100) as integer) as destination_tiebreaks_won,
  cast(l_quantity as integer) || '-' || l_linenumber as match_score,
  '$' as tourn_currency,
  '$' || cast(floor(o_totalprice) as bigint) as tourn_value
from lineitem join orders on l_orderkey = o_orderkey"""
    match_text = f"""
select m.match_id, m.tourn_id, m.tourn_name, m.tourn_place, m.tourn_round, m.tourn_round_order,
  m.source as winner_id, m.destination as loser_id, m.source_seed as winner_seed,
  m.destination_seed as loser_seed, m.match_score, m.source_sets as winner_sets,
  m.destination_sets as loser_sets, m.source_games as winner_games,
  m.destination_games as loser_games, m.source_tiebreaks_won as winner_tiebreaks_won,
  m.destination_tiebreaks_won as loser_tiebreaks_won, m.tourn_currency, m.tourn_value,
  coalesce(strftime(m.tourn_start_date, '%Y.%m.%d'), 'TBD') as tourn_start_date,
  strftime(m.tourn_end_date, '%Y.%m.%d') as tourn_end_date
from ({match_fact}) m"""
    return {
        # scans
        "scan_table": "select * from customer",
        "table_shape": "select cast(count(*) as bigint) as n_rows, 11 as n_columns from lineitem",
        "player_dim": players,
        "match_fact": match_fact,
        "tournament_dim": _with(_TITLES, "select * from tournaments"),
        "preview": "select * from orders "
        "order by o_orderkey limit 5",
        "preview_players": f"{players} order by player_id limit 5",
        "preview_matches": f"{match_fact} order by match_id limit 5",
        "describe_players": f"with t as ({players})"
        + _describe_rows(
            "turned_pro weight_kg height_cm",
            "player_id first_name last_name nationality residence birthplace handedness backhand",
        ),
        "describe_matches": f"with t as ({match_fact})"
        + _describe_rows(
            "source_seed destination_seed", "tourn_place tourn_round source destination"
        ),
        "infer_listing_types": f"with t as ({_LISTING_TEXT})" + _types(_LISTING_COLUMNS),
        "infer_match_types": f"with t as ({match_text})" + _types(_MATCH_COLUMNS),
        # expressions
        "project_rename": _with(
            _TOUR,
            """
select match_id, case when src >= 0 then 'C' || src else 'S' || (-src - 1) end as source,
  case when dst >= 0 then 'C' || dst else 'S' || (-dst - 1) end as destination
from e""",
        ),
        "parse_date": _with(
            _PLAYERS,
            f"""
select player_id, coalesce({date_text}, 'unknown') as birthdate, born as date_of_birth
from players""",
        ),
        "full_name": _with(_PLAYERS, "select player_id, full_name from players"),
        "composite_id": f"""
select l_suppkey || '_' || l_orderkey || '-' || l_partkey || '-' || l_linenumber as host_id_id
from lineitem""",
        "null_default_cast": f"""
select {raw_key},
  case when l_tax = 0 then 0 when l_tax < 0.08 then cast(l_quantity as integer) end
    as number_of_reviews,
  {_r('l_tax', 'reviews_per_month')}
from lineitem""",
        "clean_price": _with(
            _RAW_LISTINGS, "select id, price from raw_listings where price is not null"
        ),
        "outlier_range": f"""
select {raw_key}, floor(l_extendedprice / 100) as price from lineitem
where l_quantity not in (13, 17, 19) and l_extendedprice >= 1000 and l_extendedprice < 100100""",
        "log_label": _with(_RAW_LISTINGS, f"select id, {_r('label', 'label')} from listings"),
        "log1p_features": _with(
            _RAW_LISTINGS,
            f"select id, {_r('log_minimum_nights', 'log_minimum_nights')}, "
            f"{_r('log_availability', 'log_availability')} from listings",
        ),
        "safe_ratio": _with(
            _RAW_LISTINGS,
            f"select id, {_r('reviews_per_availability', 'reviews_per_availability')} "
            "from listings",
        ),
        "has_flag": _with(
            _RAW_LISTINGS, "select id, cast(has_reviews as double) as has_reviews from listings"
        ),
        "points_case": _with(
            _TITLES,
            """
select tourn_id, tourn_type, case tourn_type when 'Grand Slam' then 100
  when 'Masters 1000' then 50 when 'ATP 500' then 25 else 0 end as points
from tournaments""",
        ),
        "edge_style": _with(
            _TOUR,
            """
select match_id, src, dst, match_type || ' (' || points || ' pts)' as label,
  case match_type when 'F' then '#D32F2F' when 'S' then '#F57C00' else '#388E3C' end as color,
  case match_type when 'F' then 3 when 'S' then 2 else 1 end as pen_width
from e""",
        ),
        # profiles
        "describe_table": _describe(),
        "null_census": _census(),
        "count_by_category": "select p_type, cast(count(*) as bigint) as n from part "
        "group by p_type",
        "top_neighbourhoods": "select p_brand, cast(count(*) as bigint) as n from part "
        "group by p_brand order by n desc, p_brand limit 10",
        "price_stats": _summary("l_extendedprice", "lineitem"),
        "price_stats_clean": _with(_RAW_LISTINGS, _summary("price", "kept")),
        # graphs
        "graph_vertices": _with(_SEASON, "select distinct * from vertices"),
        "graph_edges": _with(_SEASON, "select * from edges"),
        "graph_size": _with(
            _SEASON,
            """
select 'vertices' as part, cast(count(*) as bigint) as n from vertices
union all select 'edges', cast(count(*) as bigint) from edges""",
        ),
        "triplets": _with(
            _TOUR,
            """
select e.*, a.name as src_name, a.country as src_country, b.name as dst_name,
  b.country as dst_country
from e left join v a on a.id = e.src left join v b on b.id = e.dst""",
        ),
        "reverse_edges": _with(_TOUR, "select match_id, dst as src, src as dst from e"),
        "involved_ids": _with(_TOUR, "select src as id from e union select dst from e"),
        "subgraph_edges": _with(_SEASON, event),
        "subgraph_vertices": _with(
            f"{_SEASON}, event as ({event})",
            "select * from vertices where id in (select src from event) "
            "or id in (select dst from event)",
        ),
        "pagerank": _with(
            _PAGERANK_TOP,
            f"""
select id, {_r('rank * (select count(*) from ended) / (select sum(rank) from ended)', 'rank')}
from ended""",
            recursive=True,
        ),
        # one tournament
        "match_details": _with(_TOUR, "select * from e"),
        "match_list": _with(
            _TOUR,
            """
select match_id, a.name as src_name,
  a.name || ' beat ' || b.name || ' in match ' || match_type as sentence
from e left join v a on a.id = src left join v b on b.id = dst""",
        ),
        "stage_ranking": _with(
            _TOUR,
            """
select match_type, src as id, name, cast(sum(points) as bigint) as points
from e left join v on v.id = src where match_type in ('G1', 'G2')
group by match_type, src, name""",
        ),
        "stage_results": _with(
            _TOUR,
            """
select match_id, match_type, a.name as winner, b.name as loser, points
from e left join v a on a.id = src left join v b on b.id = dst where match_type in ('S', 'F')""",
        ),
        "total_points": _with(
            _TOUR,
            """
select src as id, name, cast(sum(points) as bigint) as points
from e left join v on v.id = src group by src, name""",
        ),
        "points_ranking": _with(
            _TOUR,
            """
select id, name, coalesce(p, 0) as points, row_number() over (order by points desc, id) as rank
from v left join (select src, cast(sum(points) as bigint) as p from e group by src) on src = id""",
        ),
        "overall_winner": _with(
            _TOUR,
            """
select src as id, name, cast(sum(points) as bigint) as points
from e left join v on v.id = src group by src, name order by points desc, src limit 1""",
        ),
        "repeat_pairs": _with(
            _TOUR,
            """
select least(src, dst) as id_1, any_value(case when src < dst then a.name else b.name end) as name_1,
  greatest(src, dst) as id_2, any_value(case when src < dst then b.name else a.name end) as name_2,
  cast(count(*) as bigint) as n_matches
from e left join v a on a.id = src left join v b on b.id = dst
group by 1, 3 having count(*) > 1""",
        ),
        "ever_won": _with(_TOUR, "select * from v where id in (select src from e)"),
        "ever_lost": _with(_TOUR, "select * from v where id in (select dst from e)"),
        "won_and_lost": _with(
            _TOUR,
            "select * from v where id in (select src from e intersect select dst from e)",
        ),
        "never_won": _with(
            _TOUR,
            "select * from v where not exists (select 1 from e where e.src = v.id)",
        ),
        "never_lost": _with(
            _TOUR,
            "select * from v where not exists (select 1 from e where e.dst = v.id)",
        ),
        "win_counts": _with(
            _TOUR,
            """
select src as id, name, cast(count(*) as bigint) as wins
from e left join v on v.id = src group by src, name""",
        ),
        "win_counts_top": _with(
            _TOUR,
            """
select src as id, name, cast(count(*) as bigint) as wins
from e left join v on v.id = src group by src, name order by wins desc, src limit 3""",
        ),
        "pagerank_top": _with(
            _PAGERANK_TOP,
            f"""
select ended.id, name,
  {_r('rank * (select count(*) from ended) / (select sum(rank) from ended)', 'rank')}
from ended join v on v.id = ended.id order by ended.rank desc, ended.id limit 3""",
            recursive=True,
        ),
        # seasons
        "edges_by_tournament": _with(
            _SEASON,
            "select tournament, cast(count(*) as bigint) as n_matches from edges "
            "group by tournament order by n_matches desc, tournament limit 15",
        ),
        "edges_by_year": _with(
            _SEASON, "select year, cast(count(*) as bigint) as n_matches from edges group by year"
        ),
        "vertices_by_country": _with(
            _SEASON,
            "select nationality, cast(count(*) as bigint) as n_players from vertices "
            "group by nationality",
        ),
        "tournament_results": _with(
            _SEASON,
            f"""
select year, round_order, round, a.full_name as winner, b.full_name as loser, match_score,
  match_id
from edges left join vertices a on a.id = src left join vertices b on b.id = dst
where {_EVENT_FILTER}""",
        ),
        "important_edges": important,
        "important_edges_same_year": _with(
            f"{_SEASON}, {_TITLES}",
            f"""
select * from edges where exists (
  select 1 from tournaments where tourn_type in {_IMPORTANT}
    and lower(tourn_name) = lower(tournament) and tourn_start_year = year)""",
        ),
        "important_vertices": _with(
            f"{_SEASON}, {_TITLES}, kept as (select * from edges where {important_names})",
            "select * from vertices where id in (select src from kept union select dst from kept)",
        ),
        "important_match_counts": _with(
            f"{_SEASON}, {_TITLES}",
            "select tournament, cast(count(*) as bigint) as n_matches from edges "
            f"where {important_names} group by tournament",
        ),
        "round_robin_matches": _with(
            _SEASON, f"select * from edges where starts_with(round, '{season.ROUND_ROBIN}')"
        ),
        "round_robin_groups": _with(_GROUPS, "select * from groups", recursive=True),
        "group_players": _with(_GROUPS, "select * from grouped", recursive=True),
        "group_wins": _with(
            _SEASON,
            """
select lower(tournament) as tournament, year, src as id, cast(count(*) as bigint) as wins
from edges where round like 'Round Robin%' group by lower(tournament), year, src""",
        ),
        "group_qualifiers": _with(
            _GROUPS,
            """
select *, cast(row_number() over (
    partition by tournament, year, group_id order by wins desc, id) as integer) as rank
from (
  select grouped.*, coalesce(wins, 0) as wins
  from grouped left join wins using (tournament, year, id))
qualify rank <= 2""",
            recursive=True,
        ),
        "group_qualifiers_with_wins": _with(
            _GROUPS,
            """
select *, cast(row_number() over (
    partition by tournament, year, group_id order by wins desc, id) as integer) as rank
from (select grouped.*, wins from grouped join wins using (tournament, year, id))
qualify rank <= 2""",
            recursive=True,
        ),
        "top_by_titles": _with(
            _WON,
            """
select *, cast(row_number() over (order by titles desc, winner_id) as integer) as rank
from (
  select winner_id, tourn_winner, cast(count(*) as bigint) as titles from won
  group by all order by titles desc, winner_id limit 10)""",
        ),
        "top_by_points": _with(_WON, "select * from top_points"),
        "top_detail": _with(
            _WON,
            """
select rank, won.winner_id, won.tourn_winner, total_points, tourn_id, tourn_name, tourn_type,
  points
from won join top_points on top_points.winner_id = won.winner_id""",
        ),
        # prices
        "prepare_listings": _with(
            _RAW_LISTINGS,
            "select id, neighbourhood, room_type, number_of_reviews, "
            + ", ".join(
                _r(c, c)
                for c in (
                    "label latitude longitude minimum_nights reviews_per_month "
                    "calculated_host_listings_count availability_365 reviews_per_availability "
                    "has_reviews log_minimum_nights log_availability"
                ).split()
            )
            + " from listings",
        ),
        "hash_split": _with(
            _RAW_LISTINGS,
            "select id, case when bucket < 80 then 'train' else 'test' end as part, fold "
            "from bucketed",
        ),
        "string_index": _with(
            _INDEXED,
            """
select id, neighbourhood, room_type, cast(ni as integer) as neighbourhood_index,
  cast(ri as integer) as room_type_index
from indexed""",
        ),
        "label_indexes": _labels(),
        "mean_impute": _with(_RAW_LISTINGS, f"select id, {_IMPUTED_ROUNDED} from listings"),
        "one_hot": _with(
            _INDEXED,
            """
select id,
  cast((select count(*) + 1 from by_neighbourhood) as integer) as neighbourhood_width,
  cast(ni as bigint) as neighbourhood_slot, 1.0::double as neighbourhood_sum,
  cast((select count(*) + 1 from by_room_type) as integer) as room_type_width,
  cast(ri as bigint) as room_type_slot, 1.0::double as room_type_sum
from indexed""",
        ),
        "assemble_features": _with(
            _INDEXED,
            f"""
select id, cast((select count(*) + 1 from by_neighbourhood)
  + (select count(*) + 1 from by_room_type) + 9 as integer) as n_slots, {_ASSEMBLED}
from listings""",
        ),
        "linear_regression": _with(
            _RAW_LISTINGS,
            f"select {_r('regr_slope(label, n)', 'slope')}, "
            f"{_r('regr_intercept(label, n)', 'intercept')} from (select label, coalesce("
            "number_of_reviews, (select avg(number_of_reviews) from listings)) as n from listings)",
        ),
        "regression_metrics": _with(
            _LINEAR,
            "select "
            + ", ".join(
                [
                    _r(f"sqrt(avg(pow({p} - {y}, 2)))", f"rmse{s}")
                    + ", "
                    + _r(
                        f"1 - sum(pow({p} - {y}, 2)) / (var_pop({y}) * count(*))", f"r2{s}"
                    )
                    + ", "
                    + _r(f"avg(abs({p} - {y}))", f"mae{s}")
                    for y, p, s in (("y", "p", ""), ("exp(y)", "exp(p)", "_original"))
                ]
            )
            + " from scored",
        ),
        "score_errors": _with(
            _LINEAR,
            f"select id, {_r('exp(y)', 'actual_price')}, {_r('exp(p)', 'predicted_price')}, "
            f"{_r('exp(p) - exp(y)', 'error')}, "
            f"{_r('abs((exp(p) - exp(y)) / exp(y)) * 100', 'percent_error')} from scored",
        ),
    }
