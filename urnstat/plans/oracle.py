"""Independent SQL for the registered queries, run by DuckDB on the same tables.

Written from the semantics: plain windows over whole series, list functions and
brute force, without the layouts the Spark side uses.
"""

from __future__ import annotations

import math

from urnstat.games import G5, G6, GameSpec
from urnstat.operators.combos import PROFILE, SAMPLE
from urnstat.operators.features import feature_columns
from urnstat.plans import queries as Q

SEED = 42


def draws(spec: GameSpec = G5, name: str = "draws") -> str:
    return f"""
  {name}_q AS (
    SELECT l_orderkey AS k, CAST(l_quantity AS INT) AS n,
           MIN((l_partkey * 31 + l_suppkey * 17) % 1009) AS h, MIN(l_partkey) AS p
    FROM lineitem GROUP BY 1, 2),
  {name}_r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY h, n) AS rn FROM {name}_q),
  {name}_d AS (
    SELECT k, list_sort(list(n)) AS balls, CAST(MIN(p) % {spec.bonus_high} + 1 AS INT) AS bonus
    FROM {name}_r WHERE rn <= {spec.slots} GROUP BY k HAVING COUNT(*) = {spec.slots}),
  {name} AS (
    SELECT o_orderpriority AS series, k AS draw_id, CAST(o_orderdate AS DATE) AS draw_date,
           balls, bonus, o_totalprice AS jackpot, o_orderstatus AS outcome
    FROM {name}_d JOIN orders ON o_orderkey = k)"""


def sql(select: str, *ctes: str, spec: GameSpec = G5) -> str:
    return "WITH " + ",".join([draws(spec), *ctes]) + "\n" + select


def wide(spec: GameSpec = G5, balls: str = "balls") -> str:
    return ", ".join(f"{balls}[{i}] AS b{i}" for i in range(1, spec.slots + 1))


def each(spec: GameSpec, text: str, glue: str) -> str:
    """``text`` for every slot, ``{x}`` being the ball of the slot."""
    return "(" + glue.join(text.format(x=f"balls[{i}]") for i in range(1, spec.slots + 1)) + ")"


ISO = "strftime({0}, '%Y-%m-%d')"
MONEY = "format('{:,.2f}', jackpot)"


def r6(expression: str, name: str) -> str:
    return f"ROUND({expression}, 6) AS {name}"


# The adapter's balls are sorted, but the expressions do not rely on it.
def stat(spec: GameSpec) -> dict[str, str]:
    k = spec.slots
    s = "list_sort(balls)"
    mean = f"CAST(list_sum(balls) AS DOUBLE) / {k}"
    median = f"CAST({s}[{k // 2 + 1}] AS DOUBLE)" if k % 2 else f"({s}[{k // 2}] + {s}[{k // 2 + 1}]) / 2.0"
    return {
        "mean": mean,
        "median": median,
        "std": "SQRT(" + each(spec, f"POW({{x}} - ({mean}), 2)", " + ") + f" / {k})",
        "min": "list_min(balls)",
        "max": "list_max(balls)",
        "range": "list_max(balls) - list_min(balls)",
        "sum_without_bonus": "CAST(list_sum(balls) AS INT)",
        "sum_with_bonus": "CAST(list_sum(balls) AS INT) + bonus",
        "even_count": each(spec, "CAST({x} % 2 = 0 AS INT)", " + "),
        "odd_count": each(spec, "CAST({x} % 2 = 1 AS INT)", " + "),
        "low_range_count": each(spec, "CAST({x} <= 25 AS INT)", " + "),
        "high_range_count": each(spec, "CAST({x} > 25 AS INT)", " + "),
        "has_consecutive": "(" + " OR ".join(f"{s}[{i + 1}] - {s}[{i}] = 1" for i in range(1, k)) + ")",
        "avg_gap_between_numbers": "(" + " + ".join(f"({s}[{i + 1}] - {s}[{i}])" for i in range(1, k)) + f") / {float(k - 1)}",
    }


def stats(spec: GameSpec, names) -> str:
    own = stat(spec)
    return ", ".join(r6(own[n], n) if n in Q.REAL else f'{own[n]} AS "{n}"' for n in names)


RAW = f"""
  raw AS (
    SELECT series, draw_id,
           strftime(draw_date, '%A') || CASE WHEN draw_id % 2 = 1 THEN chr(10) ELSE ' ' END
             || strftime(draw_date, '%-d %B %Y') AS draw_date_text,
           replace(array_to_string(
             CASE WHEN draw_id % 50 = 0 THEN balls::VARCHAR[]
                  WHEN draw_id % 53 = 0 THEN [balls[1]::VARCHAR, balls[2]::VARCHAR, 'x', balls[4]::VARCHAR, balls[5]::VARCHAR, bonus::VARCHAR]
                  ELSE list_append(balls::VARCHAR[], bonus::VARCHAR) END, ' '),
             ' ', CASE WHEN draw_id % 2 = 1 THEN chr(10) || ' ' ELSE ' ' END) AS results,
           ' R' || {MONEY} || ' ' AS jackpot, outcome || ' ' AS outcome
    FROM draws),
  clean AS (
    SELECT series, draw_id, trim(regexp_replace(draw_date_text, '\\s+', ' ', 'g')) AS draw_date_raw,
           regexp_split_to_array(trim(results), '\\s+') AS t, trim(jackpot) AS jackpot, trim(outcome) AS outcome
    FROM raw WHERE len(regexp_split_to_array(trim(results), '\\s+')) = 6)"""

RAW6 = """
  raw AS (
    SELECT draw_id, strftime(draw_date, '%Y') AS year, strftime(draw_date, '%-d %B') AS date,
           CASE WHEN draw_id % 10 = 0 THEN balls[1:5] ELSE balls END::VARCHAR[] AS t, bonus::VARCHAR AS n7
    FROM draws),
  clean AS (SELECT * FROM raw WHERE len(t) = 6)"""

DATES = """
  dates AS (
    SELECT series, draw_id,
           CASE WHEN draw_id % 11 = 0 THEN 'soon' WHEN draw_id % 13 = 0 THEN 'Monday 31 February 1997'
                ELSE strftime(draw_date, '%A %-d %B %Y') END AS draw_date_raw
    FROM draws),
  dated AS (SELECT *, CAST(try_strptime(draw_date_raw, '%A %d %B %Y') AS DATE) AS draw_date FROM dates)"""


def cands(spec: GameSpec = G5) -> str:
    return f"""
  cands AS (
    SELECT draw_id AS cand_id, bonus,
           CASE WHEN draw_id % 2 = 0 THEN balls
                ELSE list_sort({each(spec, "{x} % " + str(spec.high) + " + 1", ", ").replace("(", "[", 1)[:-1]}]) END AS balls
    FROM draws)"""


NEW = f"""
  kinds AS (SELECT *, CASE WHEN draw_id % 7 = 0 THEN (draw_id // 7) % 7 ELSE -1 END AS kind FROM draws),
  newd AS (
    SELECT series, draw_id, CASE WHEN kind = 6 THEN NULL ELSE draw_date END AS draw_date,
           [CASE WHEN kind = 0 THEN 0 ELSE balls[1] END, CASE WHEN kind = 2 THEN balls[1] ELSE balls[2] END,
            balls[3], balls[4], CASE WHEN kind = 1 THEN 51 ELSE balls[5] END] AS balls,
           CASE WHEN kind = 3 THEN 21 ELSE bonus END AS bonus,
           CASE WHEN kind = 4 THEN ' ' ELSE 'R' || {MONEY} END AS jackpot,
           CASE WHEN kind = 5 THEN '' ELSE outcome END AS outcome
    FROM kinds),
  checked AS (
    SELECT *, list_filter([
        CASE WHEN draw_date IS NULL THEN 'Draw date is required' END,
        {", ".join(f"CASE WHEN balls[{i}] NOT BETWEEN 1 AND 50 THEN 'Main number {i} must be between 1 and 50' END" for i in range(1, 6))},
        CASE WHEN len(list_distinct(balls)) <> 5 THEN 'Main numbers must be unique' END,
        CASE WHEN bonus NOT BETWEEN 1 AND 20 THEN 'Bonus number must be between 1 and 20' END,
        CASE WHEN trim(jackpot) = '' THEN 'Jackpot amount is required' END,
        CASE WHEN trim(outcome) = '' THEN 'Outcome is required' END], lambda e: e IS NOT NULL) AS errors
    FROM newd)"""


def seq(source: str = "draws") -> str:
    return f"""
  seqd AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY draw_date NULLS FIRST, draw_id) - 1 AS seq
    FROM {source})"""


def look(spec: GameSpec = G5, direction: str = "past") -> str:
    """Look-back columns with one window over each whole series."""
    over = "PARTITION BY series ORDER BY seq" + (" DESC" if direction == "file" else "")
    rolling = ", ".join(
        f"CASE WHEN COUNT(*) OVER r = 10 THEN CAST(SUM(CAST(list_contains(balls, {n}) OR bonus = {n} AS INT)) OVER r AS DOUBLE) END AS frequency_{n}"
        for n in Q.TREND_NUMBERS
    )
    return f"""
  looked AS (
    SELECT *,
      CAST(COALESCE(len(list_intersect(balls, LAG(balls) OVER w)), 0) AS INT) AS prev_common_count,
      COALESCE(len(list_intersect(balls, flatten(list(balls) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))), 0)
        / {float(spec.slots)} AS hit_rate_last_5,
      {rolling}
    FROM seqd
    WINDOW w AS ({over}), r AS ({over} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def calculated(spec: GameSpec, names) -> str:
    parts = []
    for n in names:
        if n == "hit_rate_last_5":
            parts.append(r6(n, n))
        elif n == "prev_common_count":
            parts.append(n)
        else:
            parts.append(stats(spec, [n]))
    return ", ".join(parts)


def fitted(features: int) -> str:
    """Classes are the numbers up to the greatest one trained on, and zero."""
    return f"SELECT slot, MAX(number) + 1 AS classes, {features} AS features, 100 AS trees FROM cells GROUP BY slot"


def cells(spec: GameSpec = G5, source: str = "draws", key: str = "draw_id", keep: str = "TRUE") -> str:
    return f"""
  cells AS (
    SELECT {"series, " if source == "draws" else ""}{key}, CAST(UNNEST(range(1, {spec.slots + 2})) AS INT) AS slot, UNNEST(list_append(balls, bonus)) AS number
    FROM {source} WHERE {keep})"""


def probs(spec: GameSpec = G5) -> str:
    k = spec.slots
    return f"""
  pcells AS (
    {" UNION ALL ".join(f"SELECT {i} AS slot, balls[{i}] AS number FROM draws" for i in range(1, k + 1))}
    UNION ALL SELECT {k + 1}, bonus FROM draws),
  probs AS (
    SELECT CAST(slot AS INT) AS slot, number, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM draws) AS p
    FROM pcells GROUP BY 1, 2)"""


def score(spec: GameSpec = G5, source: str = "cands", places: int = Q.PLACES) -> str:
    k = spec.slots
    terms = " + ".join(f"COALESCE(p{i}.p, 0.01)" for i in range(1, k + 2))
    joins = "\n".join(
        f"    LEFT JOIN probs p{i} ON p{i}.slot = {i} AND p{i}.number = "
        + (f"balls[{i}]" if i <= k else f"{source}.bonus")
        for i in range(1, k + 2)
    )
    return f"""
  scored AS (
    SELECT {source}.*, ROUND(({terms}) / {k + 1} * 100, {places}) AS score
    FROM {source}
{joins})"""


def uniform(*parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def digest(*parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"md5({text})"


def greedy(spec: GameSpec = G5) -> str:
    """One step per slot: best number not picked by an earlier step."""
    k = spec.slots
    out = []
    for i in range(1, k + 2):
        seen = "" if i > k else "".join(f" AND number <> (SELECT number FROM g{j})" for j in range(1, i))
        out.append(f"""
  g{i} AS (SELECT number, p FROM probs WHERE slot = {i}{seen} ORDER BY p DESC, number LIMIT 1)""")
    numbers = ", ".join(f"(SELECT number FROM g{i})" for i in range(1, k + 1))
    total = " + ".join(f"(SELECT p FROM g{i})" for i in range(1, k + 2))
    out.append(f"""
  greedy AS (
    SELECT list_sort([{numbers}]) AS balls, (SELECT number FROM g{k + 1}) AS bonus,
           ROUND(({total}) / {k + 1} * 100, {Q.PLACES}) AS score)""")
    return ",".join(out)


def weighted(spec: GameSpec, n: int, tries: int) -> str:
    """One step per slot: earliest arrival among unused numbers, per candidate."""
    k = spec.slots
    out = [f"""
  w0 AS (SELECT range AS cand_id, CAST([] AS INT[]) AS used, CAST(0 AS DOUBLE) AS total FROM range({tries}))"""]
    for i in range(1, k + 1):
        out.append(f"""
  w{i} AS (
    SELECT cand_id, list_append(ANY_VALUE(used), arg_min(number, (t, number))) AS used,
           ANY_VALUE(total) + arg_min(p, (t, number)) AS total
    FROM (SELECT cand_id, used, total, number, p, -LN({uniform("cand_id", str(i), "number")}) / p AS t
          FROM w{i - 1}, probs WHERE slot = {i} AND NOT list_contains(used, number))
    GROUP BY cand_id)""")
    out.append(f"""
  wb AS (
    SELECT cand_id, list_sort(ANY_VALUE(used)) AS balls, arg_min(number, (t, number)) AS bonus,
           ANY_VALUE(total) + arg_min(p, (t, number)) AS total
    FROM (SELECT cand_id, used, total, number, p, -LN({uniform("cand_id", str(k + 1), "number")}) / p AS t
          FROM w{k}, probs WHERE slot = {k + 1})
    GROUP BY cand_id),
  weighted AS (
    SELECT MIN(cand_id) AS cand_id, balls, bonus, ROUND(arg_min(total, cand_id) / {k + 1} * 100, {Q.PLACES}) AS score
    FROM wb GROUP BY balls, bonus ORDER BY 1 LIMIT {n})""")
    return ",".join(out)


def sampled(spec: GameSpec, n: int, tries: int) -> str:
    return f"""
  mains AS (
    SELECT cand_id, list_sort(list(number)) AS balls FROM (
      SELECT c.range AS cand_id, CAST(d.range AS INT) AS number,
             ROW_NUMBER() OVER (PARTITION BY c.range ORDER BY {digest("c.range", "d.range")}, d.range) AS rn
      FROM range({tries}) c, range(1, {spec.high + 1}) d) WHERE rn <= {spec.slots} GROUP BY 1),
  bonuses AS (
    SELECT c.range AS cand_id, arg_min(CAST(d.range AS INT), ({digest("c.range", "'bonus'", "d.range")}, d.range)) AS bonus
    FROM range({tries}) c, range(1, {spec.bonus_high + 1}) d GROUP BY 1),
  sample AS (
    SELECT MIN(cand_id) AS cand_id, balls, bonus FROM mains JOIN bonuses USING (cand_id)
    GROUP BY balls, bonus ORDER BY 1 LIMIT {n})"""


def ends(columns: str) -> str:
    return f"""SELECT 'best' AS kind, * FROM (SELECT {columns} FROM scored ORDER BY score DESC, cand_id LIMIT 1)
UNION ALL SELECT 'worst', * FROM (SELECT {columns} FROM scored ORDER BY score, cand_id DESC LIMIT 1)"""


def brute() -> str:
    """All combinations of five, each scored; ties go to the smallest numbers."""
    unit = 10**12
    alias = "abcde"
    froms = ", ".join(f"u{i} {c}" for i, c in enumerate(alias, 1))
    where = " AND ".join(f"{x}.n < {y}.n" for x, y in zip(alias, alias[1:]))
    units = ", ".join(
        f"""
  u{i} AS (SELECT CAST(range AS INT) AS n, CAST(ROUND(COALESCE(p, 0.01) * {unit}) AS BIGINT) AS u
         FROM range(1, {51 if i < 6 else 21}) LEFT JOIN probs ON slot = {i} AND number = range)"""
        for i in range(1, 7)
    )
    out = [units, f"""
  paths AS (SELECT [{", ".join(c + ".n" for c in alias)}] AS balls, {" + ".join(c + ".u" for c in alias)} AS u FROM {froms} WHERE {where})"""]
    return ",".join(out)


def brute_select() -> str:
    rows = []
    for kind, way in (("best", "DESC"), ("worst", "ASC")):
        rows.append(f"""SELECT '{kind}' AS kind, {wide()}, n AS bonus, ROUND((paths.u + u6.u) / 1000000000000.0 / 6 * 100, {Q.PLACES}) AS score
FROM (SELECT * FROM paths ORDER BY u {way}, balls LIMIT 1) paths, (SELECT * FROM u6 ORDER BY u {way}, n LIMIT 1) u6""")
    return "\nUNION ALL ".join(rows)


FILL = f"""
  pool AS (
    SELECT pred_id, list_distinct_kept AS kept, ANY_VALUE(bonus) AS bonus,
           list(CAST(d.range AS INT) ORDER BY {digest("pred_id", "d.range")}, d.range)
             FILTER (NOT list_contains(list_distinct_kept, CAST(d.range AS INT))) AS free
    FROM (SELECT draw_id AS pred_id, CAST(bonus + draw_id % 3 * 8 AS INT) AS bonus,
                 list_sort(list_distinct({each(G5, "{x} % 12 + 1", ", ").replace("(", "[", 1)[:-1]}])) AS list_distinct_kept FROM draws),
         range(1, 51) d
    GROUP BY pred_id, list_distinct_kept),
  spare AS (
    SELECT draw_id AS pred_id, arg_min(CAST(d.range AS INT), ({digest("draw_id", "'bonus'", "d.range")}, d.range)) AS bonus
    FROM draws, range(1, 21) d GROUP BY 1),
  filled AS (
    SELECT pred_id, list_sort(list_concat(kept, free[1:5 - len(kept)])) AS balls,
           CASE WHEN pool.bonus BETWEEN 1 AND 20 THEN pool.bonus ELSE spare.bonus END AS bonus
    FROM pool JOIN spare USING (pred_id))"""

# A drawn prediction gets a free set whenever the game has one.
AVOIDED = """SELECT pred_id, drawn AND free > 0 AS replaced, drawn AND free = 0 AS exhausted, NOT (drawn AND free = 0) AS legal,
  NOT drawn AS kept, FALSE AS drawn FROM asked, (SELECT {sets} - COUNT(DISTINCT key) AS free FROM keys)"""
AVOID = """
  keys AS (SELECT DISTINCT list_sort(list_distinct(balls)) AS key FROM draws),
  asked AS (SELECT cand_id AS pred_id, list_sort(list_distinct(balls)) IN (SELECT key FROM keys) AS drawn FROM cands)"""
DENSE = f"""
  folded AS (
    SELECT draw_id, list_sort(list_distinct(list_transform(balls, lambda b: b % {Q.DENSE.high} + 1)))[1:{Q.DENSE.slots}] AS key FROM draws),
  keys AS (SELECT DISTINCT key FROM folded WHERE len(key) = {Q.DENSE.slots}),
  asked AS (SELECT draw_id AS pred_id, TRUE AS drawn FROM folded WHERE len(key) = {Q.DENSE.slots})"""
TRAINING = f"{uniform('draw_id')} < 0.8"

PROFILE_VALUES = [
    "CAST(ROUND({mean}, 2) AS VARCHAR)",
    "CAST({median} AS VARCHAR)",
    "CAST({range} AS VARCHAR)",
    "CAST({sum_without_bonus} AS VARCHAR)",
    "CAST({sum_with_bonus} AS VARCHAR)",
    "CAST({even_count} AS VARCHAR)",
    "CAST({odd_count} AS VARCHAR)",
    "CAST({low_range_count} AS VARCHAR)",
    "CAST({high_range_count} AS VARCHAR)",
    "CASE WHEN {has_consecutive} THEN 'Yes' ELSE 'No' END",
    "CASE WHEN list_sort(list_distinct(balls)) IN (SELECT list_sort(list_distinct(balls)) FROM draws) THEN 'Yes' ELSE 'No' END",
]


def counted(slots: str = "TRUE") -> str:
    return f"SELECT number, COUNT(*) AS frequency FROM cells WHERE {slots} GROUP BY number"


def filled(high: int, counts: str, value: str = "frequency") -> str:
    return f"SELECT CAST(range AS INT) AS number, COALESCE({value}, 0) AS {value} FROM range(1, {high + 1}) LEFT JOIN ({counts}) c ON c.number = range"


def grid(high: int, counts: str) -> str:
    cols = ", ".join(f"CAST(SUM(CASE WHEN (number - 1) % 10 = {i} THEN frequency END) AS BIGINT) AS c{i}" for i in range(10))
    return f'SELECT CAST((number - 1) // 10 AS INT) AS "row", {cols} FROM ({filled(high, counts)}) GROUP BY 1'


def dist(name: str) -> str:
    return sql(f"SELECT {stat(G5)[name]} AS value, COUNT(*) AS frequency FROM draws GROUP BY 1")


REPORT = """'{label}' AS model, COUNT(*) AS draws, strftime(MIN(draw_date), '%Y-%m-%d') AS first_date,
  strftime(MAX(draw_date), '%Y-%m-%d') AS last_date, 14 AS features, 6 AS targets, {trees} AS trees"""
SUMMARY = """SELECT series, COUNT(*) AS draws, MAX(seq) AS last_seq, CAST(SUM(prev_common_count) AS BIGINT) AS prev_common_total,
  CAST(SUM(CAST(hit_rate_last_5 * 5 AS INT)) AS BIGINT) AS hit_total, CAST(SUM(list_sum(balls) + bonus) AS BIGINT) AS ball_total
FROM looked GROUP BY series"""
SPLIT = (f"draw_date < DATE '{Q.SPLIT_DAY}'", f"draw_date >= DATE '{Q.SPLIT_DAY}'")


def merged(old: str, new: str) -> str:
    """History and accepted typed-in draws."""
    return f"""
  merged AS (
    SELECT series, draw_id, draw_date, balls, bonus FROM draws WHERE {old} UNION ALL
    SELECT series, draw_id + {Q.NEW_ID_SHIFT}, draw_date, balls, bonus FROM checked WHERE len(errors) = 0 AND {new})"""


NEWEST = "ORDER BY draw_date DESC, draw_id DESC"


def oracle_sql() -> dict[str, str]:
    keys = "series, draw_id"
    iso = ISO.format("draw_date") + " AS draw_date"
    main_cells = "slot <= 5"
    tree = "CAST(draw_id AS VARCHAR) || ':' || CAST(t.range // 4 AS VARCHAR)"
    tree_draw = f"((CAST('0x' || substr(md5('{SEED}:' || {tree}), CAST(8 * (t.range % 4) + 1 AS INT), 8) AS BIGINT) + 0.5) / 4294967296.0)"
    likelihood = f"SELECT number, SUM(p) / {{k}} * 100 AS likelihood FROM probs WHERE slot <= {{k}} GROUP BY 1"
    out = {
        "clean_g5": sql(f"SELECT {keys}, draw_date_raw, {', '.join(f't[{i}] AS n{i}' for i in range(1, 7))}, jackpot, outcome FROM clean", RAW),
        "clean_g6": sql(f"SELECT draw_id, year, date, {', '.join(f't[{i}] AS n{i}' for i in range(1, 7))}, n7 FROM clean", RAW6, spec=G6),
        "tolerant_parse": sql(
            f"SELECT {keys}, {', '.join(f'CAST(t[{i}] AS INT) AS b{i}' for i in range(1, 6))}, CAST(t[6] AS INT) AS bonus FROM clean "
            "WHERE " + " AND ".join(f"TRY_CAST(t[{i}] AS INT) IS NOT NULL" for i in range(1, 7)),
            RAW,
        ),
        "parse_dates": sql(f"SELECT {keys}, draw_date_raw, {iso} FROM dated", DATES),
        "day_name": sql(
            "SELECT draw_id, strftime(d, '%Y-%m-%d') AS draw_date, dayname(d) AS day "
            "FROM (SELECT draw_id, strptime(date || ' ' || year, '%d %B %Y') AS d FROM clean)",
            RAW6,
            spec=G6,
        ),
        "append_draw": sql(
            f"SELECT {keys}, {iso}, {wide()}, bonus, 'R' || {MONEY} AS jackpot, outcome FROM draws UNION ALL "
            f"SELECT series, draw_id + {Q.NEW_ID_SHIFT}, {iso}, {wide()}, bonus, jackpot, outcome FROM checked WHERE len(errors) = 0",
            NEW,
        ),
        "has_consecutive": sql(f"SELECT {keys}, {stats(G5, ['has_consecutive'])} FROM draws"),
        "avg_gap": sql(f"SELECT {keys}, {stats(G5, ['avg_gap_between_numbers'])} FROM draws"),
        "indicators": sql(
            f"SELECT {keys}, "
            + ", ".join(f"CAST(list_contains(balls, {n}) OR bonus = {n} AS INT) AS number_{n}" for n in Q.TREND_NUMBERS)
            + " FROM draws"
        ),
        "pattern_table": sql(
            f"SELECT {keys}, {stats(G5, ['even_count', 'odd_count', 'low_range_count', 'high_range_count', 'sum_without_bonus'])}, "
            f"CAST({stat(G5)['has_consecutive']} AS INT) AS has_consecutive FROM draws"
        ),
        "format_prediction": sql(
            "SELECT cand_id, array_to_string(balls, ', ') AS main_numbers, CAST(bonus AS VARCHAR) AS bonus_number, "
            f"CASE WHEN {stat(G5)['has_consecutive']} THEN 'Yes' ELSE 'No' END AS has_consecutive FROM cands",
            cands(),
        ),
        "explode_slots": sql(f"SELECT {keys}, slot, number FROM cells", cells()),
        "filter_dates": sql(f"SELECT {keys}, {iso} FROM draws WHERE draw_date >= DATE '{Q.SLICE_START}' AND draw_date <= DATE '{Q.SLICE_END}'"),
        "filter_recent": sql(
            f"SELECT {keys}, {iso} FROM draws QUALIFY ROW_NUMBER() OVER (PARTITION BY series {NEWEST}) <= 500"
        ),
        "filter_recent_2000": sql(
            f"SELECT {keys}, {iso} FROM draws QUALIFY ROW_NUMBER() OVER (PARTITION BY series {NEWEST}) <= 2000"
        ),
        "trainable_series": sql(f"SELECT {keys} FROM draws QUALIFY COUNT(*) OVER (PARTITION BY series) >= 1000"),
        "date_range_info": sql(
            f"SELECT {ISO.format('MIN(draw_date)')} AS earliest, {ISO.format('MAX(draw_date)')} AS latest, COUNT(*) AS total_draws FROM dated",
            DATES,
        ),
        "drop_undated": sql(f"SELECT {keys}, {iso} FROM dated WHERE draw_date IS NOT NULL", DATES),
        "recent_10": sql(f"SELECT {keys}, {ISO.format('draw_date')} AS draw_date, {wide()}, bonus FROM (SELECT * FROM draws {NEWEST} LIMIT 10)"),
        "recent_100": sql(
            f"SELECT {keys}, {iso}, {calculated(G5, Q.CALCULATED)} FROM (SELECT * FROM looked {NEWEST} LIMIT 100)", seq(), look()
        ),
        "validate_draws": sql(f"SELECT {keys}, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM checked", NEW),
        "reject_counts": sql("SELECT error, COUNT(*) AS draws FROM (SELECT UNNEST(errors) AS error FROM checked) GROUP BY 1", NEW),
        "with_seq": sql(f"SELECT {keys}, seq FROM seqd", seq()),
        "trend_table": sql(
            f"SELECT series, seq, {iso}, {', '.join(f'frequency_{n}' for n in Q.TREND_NUMBERS)} FROM looked", seq(), look()
        ),
        "join_by_seq": sql(
            f"SELECT series, seq, draw_id, {calculated(G5, ['sum_without_bonus', 'hit_rate_last_5', 'avg_gap_between_numbers'])} FROM looked",
            seq(),
            look(),
        ),
        "train_split": sql(f"SELECT {keys}, {uniform('draw_id')} < 0.8 AS is_train FROM draws"),
        "freq_slots": sql(counted("slot >= 2"), cells()),
        "freq_ranked": sql(
            f"SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY frequency DESC, number) AS INT) AS rank FROM ({counted()})", cells()
        ),
        "fill_domain": sql(filled(52, counted("slot <= 6")), cells(G6), spec=G6),
        "main_grid": sql(grid(50, counted(main_cells)), cells()),
        "bonus_grid": sql(grid(20, counted("slot = 6")), cells()),
        "dist_even": dist("even_count"),
        "dist_odd": dist("odd_count"),
        "dist_low": dist("low_range_count"),
        "dist_high": dist("high_range_count"),
        "sum_histogram": sql(
            "SELECT CAST(range AS INT) AS bin, ROUND(lo + range * (hi - lo) / 20.0, 6) AS left_edge, "
            "ROUND(lo + (range + 1) * (hi - lo) / 20.0, 6) AS right_edge, COUNT(bin) AS frequency "
            "FROM range(20), ends LEFT JOIN binned ON bin = range GROUP BY range, lo, hi",
            """
  sums AS (SELECT CAST(list_sum(balls) AS INT) AS x FROM draws),
  ends AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM sums),
  binned AS (SELECT LEAST((x - lo) * 20 // (hi - lo), 19) AS bin FROM sums, ends)""",
        ).replace("FROM range(20), ends LEFT JOIN binned ON bin = range", "FROM range(20) CROSS JOIN ends LEFT JOIN binned ON bin = range"),
        "consecutive_share": sql(
            f"SELECT {stat(G5)['has_consecutive']} AS has_consecutive, COUNT(*) AS frequency, "
            "ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM draws), 1) AS percent FROM draws GROUP BY 1"
        ),
        "history_profile": sql(
            "SELECT "
            + ", ".join(
                [r6(f"AVG({stat(G5)[n]})", n) for n in ("mean", "median", "std")]
                + [f'MIN({stat(G5)["min"]}) AS "min"', f'MAX({stat(G5)["max"]}) AS "max"', f'MAX({stat(G5)["range"]}) AS "range"']
            )
            + " FROM draws"
        ),
        "exclude_drawn": sql(
            f"SELECT cand_id, {wide()}, bonus FROM cands "
            "WHERE list_sort(list_distinct(balls)) NOT IN (SELECT list_sort(list_distinct(balls)) FROM draws)",
            cands(),
        ),
        "dedupe_combos": sql(
            f"SELECT cand_id, {wide()}, bonus FROM (SELECT cand_id * 2 AS cand_id, balls, bonus FROM cands "
            "UNION ALL SELECT draw_id * 2 + 1, balls, bonus FROM draws) "
            "QUALIFY ROW_NUMBER() OVER (PARTITION BY list_sort(balls), bonus ORDER BY cand_id) = 1",
            cands(),
        ),
        "complete_prediction": sql(f"SELECT pred_id, {wide()}, bonus FROM filled", FILL),
        "avoid_drawn": sql(AVOIDED.format(sets=math.comb(50, 5)), cands(), AVOID),
        "avoid_drawn_dense": sql(AVOIDED.format(sets=math.comb(Q.DENSE.high, Q.DENSE.slots)), DENSE),
        "combo_profile": sql(
            "\nUNION ALL ".join(
                f"SELECT cand_id, '{name}' AS stat, {value.format(**stat(G5))} AS value FROM cands"
                for name, value in zip(PROFILE, PROFILE_VALUES)
            ),
            cands(),
        ),
        "hypothetical_features": sql(
            "SELECT cand_id, "
            + ", ".join(
                [f'(SELECT ROUND(AVG({stat(G5)[n]}), 6) FROM draws) AS "{n}"' for n in ("mean", "median", "std")]
                + [f'(SELECT MIN({stat(G5)["min"]}) FROM draws) AS "min"']
                + [f'(SELECT MAX({stat(G5)[n]}) FROM draws) AS "{n}"' for n in ("max", "range")]
            )
            + f", {stats(G5, ['sum_without_bonus', 'even_count', 'odd_count', 'low_range_count', 'high_range_count'])}, "
            f"0 AS prev_common_count, CAST({stat(G5)['has_consecutive']} AS INT) AS has_consecutive FROM cands",
            cands(),
        ),
        "bonus_likelihood": sql(
            "SELECT number, ROUND(likelihood, 6) AS likelihood FROM ("
            + filled(20, "SELECT number, p * 100 AS likelihood FROM probs WHERE slot = 6", "likelihood")
            + ")",
            probs(),
        ),
        "likelihood_ranked": sql(
            "SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY likelihood DESC, number) AS INT) AS rank FROM ("
            "SELECT number, ROUND(likelihood, 6) AS likelihood FROM ("
            + filled(50, likelihood.format(k=5), "likelihood")
            + "))",
            probs(),
        ),
        "rank_slots": sql(
            "SELECT slot, number, ROUND(p, 6) AS p, CAST(ROW_NUMBER() OVER (PARTITION BY slot ORDER BY p DESC, number) AS INT) AS rank FROM probs",
            probs(),
        ),
        "predict_slots": sql("SELECT slot, number FROM probs QUALIFY ROW_NUMBER() OVER (PARTITION BY slot ORDER BY p DESC, number) = 1", probs()),
        "lookup_probs": sql(
            "SELECT cand_id, slot, number, ROUND(COALESCE(p, 0.01), 6) AS p FROM cells LEFT JOIN probs USING (slot, number)",
            cands(),
            probs(),
            cells(source="cands", key="cand_id"),
        ),
        "score_combos": sql("SELECT cand_id, score FROM scored", cands(), probs(), score()),
        "compare_scores": sql(
            "SELECT cand_id, scored.score AS score, greedy.score AS reference_score, "
            "CASE WHEN scored.score > greedy.score THEN 'higher' WHEN scored.score < greedy.score THEN 'lower' ELSE 'same' END AS verdict "
            "FROM scored, greedy",
            cands(),
            probs(),
            score(),
            greedy(),
        ),
        "best_worst": sql(ends("cand_id, score"), cands(), probs(), score()),
        "exact_extremes": sql(brute_select(), probs(), brute()),
        "predict": sql(
            f"SELECT {wide(balls='CASE WHEN seen THEN other ELSE balls END')}, bonus, seen AS replaced FROM ended",
            probs(),
            f"""
  best AS (SELECT slot, number FROM probs QUALIFY ROW_NUMBER() OVER (PARTITION BY slot ORDER BY p DESC, number) = 1),
  kept AS (SELECT list_distinct(list(number)) AS kept FROM best WHERE slot <= 5),
  free AS (
    SELECT list(CAST(range AS INT) ORDER BY {digest("0", "range")}, range) AS free
    FROM range(1, 51) WHERE NOT list_contains((SELECT kept FROM kept), CAST(range AS INT))),
  legal AS (
    SELECT list_sort(list_concat(kept, free[1:5 - len(kept)])) AS balls, (SELECT number FROM best WHERE slot = 6) AS bonus FROM kept, free),
  keys AS (SELECT DISTINCT list_sort(balls) AS key FROM draws),
  other AS (
    SELECT attempt, list_sort(list(number)) AS balls FROM (
      SELECT a.range AS attempt, CAST(d.range AS INT) AS number,
             ROW_NUMBER() OVER (PARTITION BY a.range ORDER BY {digest("0", "a.range", "d.range")}, d.range) AS rn
      FROM range(1, 101) a, range(1, 51) d) WHERE rn <= 5 GROUP BY 1),  -- more tries than these data need
  ended AS (
    SELECT balls, bonus, balls IN (SELECT key FROM keys) AS seen,
           (SELECT arg_min(balls, (CAST(balls IN (SELECT key FROM keys) AS INT), attempt)) FROM other) AS other FROM legal)""",
        ),
        "training_report": sql(
            f"SELECT {REPORT.format(label='Custom Date Range', trees=100)} FROM draws "
            f"WHERE draw_date BETWEEN DATE '{Q.SLICE_START}' AND DATE '{Q.SLICE_END}'"
        ),
        "training_report_recent": sql(
            f"SELECT {REPORT.format(label='Recent Draws', trees=100)} FROM (SELECT * FROM draws "
            f"QUALIFY ROW_NUMBER() OVER (PARTITION BY series {NEWEST}) <= 500)"
        ),
        "forest_full": sql(f"SELECT {REPORT.format(label='Full Dataset', trees=100)} FROM draws"),
        "forest_fit_summary": sql(fitted(14), cells(keep=TRAINING)),
        "forest_fit_summary_g6": sql(fitted(13), cells(G6, keep=TRAINING), spec=G6),
        "forest_saved": sql(fitted(14), cells(keep=TRAINING)),
        "holdout_facts": sql(
            f"SELECT slot, (SELECT COUNT(*) FROM draws WHERE NOT {TRAINING}) AS rows, MAX(n) AS commonest, TRUE AS better "
            "FROM (SELECT slot, number, COUNT(*) AS n FROM cells WHERE slot <= 5 GROUP BY 1, 2) GROUP BY 1",
            cells(keep=f"NOT {TRAINING}"),
        ),
        "untrained_facts": sql(
            "SELECT slot, MAX(number) - COUNT(DISTINCT number) AS numbers, 0::DOUBLE AS p FROM cells GROUP BY 1", cells(keep=TRAINING)
        ),
        "first_slot_facts": sql(f"SELECT COUNT(*) AS rows, TRUE AS most_are_min FROM draws WHERE NOT {TRAINING}"),
        "oob_facts": sql(
            f"""SELECT CAST(slots.range AS INT) AS slot, COUNT(*) AS rows, COUNT(*) FILTER (voters = 0) AS unvoted,
       ROUND(AVG(voters), 6) AS voters, TRUE AS near_holdout
FROM (SELECT draw_id, COUNT(*) FILTER ({tree_draw} < exp(-1.0)) AS voters
      FROM draws CROSS JOIN range({Q.FOREST["num_trees"]}) t WHERE {TRAINING} GROUP BY 1) CROSS JOIN range(1, 7) slots
GROUP BY 1"""
        ),
        "forest_probs_check": sql(
            "SELECT series, slot, numbers, 1.0::DOUBLE AS total FROM (SELECT DISTINCT series FROM draws), "
            "(SELECT slot, CAST(MAX(number) AS BIGINT) AS numbers FROM cells GROUP BY slot)",
            cells(keep=TRAINING),
        ),
        "forest_likelihood_check": sql("SELECT DISTINCT series, 50::BIGINT AS numbers, TRUE AS adds_to_100 FROM draws"),
        "forest_predict_check": sql("SELECT DISTINCT series, TRUE AS legal, FALSE AS drawn FROM draws"),
        "forest_scores_check": sql(
            "SELECT series, draw_id AS cand_id, TRUE AS in_range FROM draws"
        ),
        "holdout_check": sql(
            f"SELECT CAST(range AS INT) AS slot, (SELECT COUNT(*) FROM draws WHERE NOT {TRAINING}) AS rows, TRUE AS in_range FROM range(1, 7)"
        ),
        "score_hypothetical_check": sql("SELECT draw_id AS cand_id, TRUE AS in_range FROM draws"),
        "stream_calculated": sql(SUMMARY, NEW, merged("FALSE", "TRUE"), seq("merged"), look()),
        "two_streams": sql(SUMMARY, NEW, merged(*SPLIT), seq("merged"), look()),
        "stream_then_ingest": sql(SUMMARY, NEW, merged(*SPLIT), seq("merged"), look()),
        "ingest_many": sql(SUMMARY, NEW, merged("TRUE", "FALSE"), seq("merged"), look()),
        "ingest_late": sql(SUMMARY, NEW, merged("TRUE", f"series = '{Q.LATE_SERIES}'"), seq("merged"), look()),
        "read_raw_g5": sql(
            f"SELECT {iso}, COUNT(*) AS draws, CAST(SUM(balls[1] + bonus) AS BIGINT) AS numbers FROM draws "
            "WHERE draw_id % 50 <> 0 AND draw_id % 53 <> 0 GROUP BY 1"
        ),
        "read_raw_g6": sql(
            "SELECT year, COUNT(*) AS draws, CAST(SUM(CAST(t[1] AS INT)) AS BIGINT) AS numbers FROM clean GROUP BY 1", RAW6, spec=G6
        ),
        "clean_file": sql(
            f"SELECT series, draw_id, {iso}, {wide()}, bonus, balls[1] AS csv_b1, bonus AS csv_bonus, outcome FROM draws"
        ),
        "required_columns": sql(
            "SELECT COUNT(*) AS draws, features, features AS missing, TRUE AS refused "
            "FROM draws CROSS JOIN (SELECT UNNEST([12, 13, 14])::INT AS features) GROUP BY features"
        ),
        "frequency_file": sql(f"SELECT number AS \"Number\", frequency AS \"Frequency\" FROM ({counted()})", cells()),
        "ingest_result": sql(SUMMARY, NEW, merged("TRUE", "TRUE"), seq("merged"), look()),
        "ingest_tail": sql(SUMMARY, NEW, merged(*SPLIT), seq("merged"), look()),
        "ingest_frequency": sql(
            "SELECT number, COUNT(*) AS frequency FROM (SELECT UNNEST(list_append(balls, bonus)) AS number FROM merged) GROUP BY 1",
            NEW,
            merged(*SPLIT),
        ),
        "stream_frequency": sql(
            "SELECT number, COUNT(*) AS frequency FROM (SELECT UNNEST(list_append(balls, bonus)) AS number FROM checked WHERE len(errors) = 0) GROUP BY 1",
            NEW,
        ),
        "stream_intake": sql(f"SELECT {keys}, {iso}, {wide()}, bonus FROM checked WHERE len(errors) = 0", NEW),
    }
    for spec, tail in ((G5, ""), (G6, "_g6")):
        k = spec.slots
        out[f"row_stats{tail}"] = sql(f"SELECT {keys}, {stats(spec, Q.STATS)} FROM draws", spec=spec)
        out[f"parity_counts{tail}"] = sql(f"SELECT {keys}, {stats(spec, ['even_count', 'odd_count'])} FROM draws", spec=spec)
        out[f"range_counts{tail}"] = sql(f"SELECT {keys}, {stats(spec, ['low_range_count', 'high_range_count'])} FROM draws", spec=spec)
        out[f"calculated_draws{tail}"] = sql(
            f"SELECT {keys}, seq, {wide(spec)}, bonus, {calculated(spec, Q.CALCULATED)} FROM looked", seq(), look(spec), spec=spec
        )
        out[f"freq_all{tail}"] = sql(counted(), cells(spec), spec=spec)
        out[f"already_drawn{tail}"] = sql(
            "SELECT cand_id, list_sort(list_distinct(balls)) IN (SELECT list_sort(list_distinct(balls)) FROM draws) AS drawn FROM cands",
            cands(spec),
            spec=spec,
        )
        out[f"number_likelihood{tail}"] = sql(
            "SELECT number, ROUND(likelihood, 6) AS likelihood FROM ("
            + filled(spec.high, likelihood.format(k=k), "likelihood")
            + ")",
            probs(spec),
            spec=spec,
        )
        out[f"greedy_combo{tail}"] = sql(f"SELECT {wide(spec)}, bonus, score FROM greedy", probs(spec), greedy(spec), spec=spec)
        out[f"weighted_combos{tail}"] = sql(
            f"SELECT cand_id, {wide(spec)}, bonus, score FROM weighted", probs(spec), weighted(spec, Q.WEIGHTED, 2 * Q.WEIGHTED), spec=spec
        )
        out[f"sampled_extremes{tail}"] = sql(
            ends(f"cand_id, {wide(spec)}, bonus, score"),
            probs(spec),
            sampled(spec, SAMPLE, 2 * SAMPLE),
            score(spec, "sample"),
            spec=spec,
        )
    for direction, tail in (("past", ""), ("file", "_file")):
        looked = (seq(), look(direction=direction))
        out[f"prev_common_count{tail}"] = sql("SELECT series, seq, prev_common_count FROM looked", *looked)
        out[f"hit_rate_last_5{tail}"] = sql("SELECT series, seq, ROUND(hit_rate_last_5, 6) AS hit_rate_last_5 FROM looked", *looked)
        out[f"rolling_frequency{tail}"] = sql(
            "\nUNION ALL ".join(
                f"SELECT series, seq, {n} AS number, frequency_{n} AS frequency FROM looked" for n in Q.TREND_NUMBERS
            ),
            *looked,
        )
    for kind, tail in ((14, ""), (13, "_13"), (12, "_12")):
        names = feature_columns(kind)
        inputs = calculated(G5, names)
        if kind == 13:
            inputs = inputs.replace(stats(G5, ["has_consecutive"]), f"CAST({stat(G5)['has_consecutive']} AS INT) AS has_consecutive")
        out[f"feature_matrix{tail}"] = sql(f"SELECT {keys}, {inputs}, {wide()}, bonus FROM looked", seq(), look())
    for which, tail, way in (("latest", "", "DESC"), ("oldest", "_oldest", "ASC")):
        out[f"scoring_row{tail}"] = sql(
            f"SELECT series, seq, draw_id, {calculated(G5, feature_columns(14))} FROM looked "
            f"QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY seq {way}) = 1",
            seq(),
            look(),
        )
    names = feature_columns(14)
    before = ", ".join(f'LAG("{n}") OVER (PARTITION BY series ORDER BY seq) AS "prev_{n}"' for n in names)
    out["lagged_matrix"] = sql(
        f"SELECT {keys}, {before}, {wide()}, bonus FROM (SELECT {keys}, seq, balls, bonus, {calculated(G5, names)} FROM looked)", seq(), look()
    )
    out["stored_range"], out["stored_recent"] = out["filter_dates"], out["filter_recent"]
    out["calculated_file"] = out["calculated_draws"]
    out["prediction_file"] = f"SELECT number, likelihood, '2025-04-26' AS run_date FROM ({out['number_likelihood']})"
    return out
