"""The SQL twin of the timestamp operator: common table expressions that end in instants(photo_id, field, utc_micros)."""

_OFFSETS = """
    UTC 0, GMT 0, Z 0, EST -18000, EDT -14400, PST -28800, PDT -25200, NST -12600, NDT -9000, CET 3600, CEST 7200, BST 3600,
    IST 19800, JST 32400, CST 28800, AEST 36000, AEDT 39600
"""
_letters = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (x.split() for x in _OFFSETS.split(",")))
_months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"

INSTANTS = rf"""
t0 AS (
  SELECT DISTINCT id, f.field, regexp_replace(CASE f.field WHEN 'shot_at' THEN shot_at ELSE created_at END, '^\s+|\s+$', '', 'g') AS x,
    CASE f.field WHEN 'shot_at' THEN tz_name ELSE 'UTC' END AS tz, date_order = 'mdy' AS mdy
  FROM photos LEFT JOIN project_settings USING (project_id), (VALUES ('shot_at'), ('created_at')) f(field)),
t1 AS (SELECT *, nullif(regexp_extract(x, '\[([^\]]+)\]$', 1), '') AS place, regexp_replace(x, ' ?\[[^\]]+\]$', '') AS x1 FROM t0),
t2 AS (SELECT *, nullif(regexp_extract(x1, '\d[:T_]?\d{{2}}(?:[.,]\d+)? ?(Z|[+-]\d{{2}}:?\d{{2}})$', 1), '') AS off FROM t1),
t3 AS (SELECT *, CASE WHEN off IS NULL THEN x1 ELSE rtrim(left(x1, length(x1) - length(off))) END AS x2 FROM t2),
t4 AS (SELECT *, nullif(regexp_extract(x2, ' (AM|PM)$', 1), '') AS half, nullif(regexp_extract(x2, ':\d{{2}} ([A-Z]{{3,5}})$', 1), '') AS code FROM t3),
t5 AS (SELECT *, regexp_replace(x2, ' [A-Z]+$', '') AS x3 FROM t4),
t6 AS (SELECT *, regexp_extract(x3, ':\d{{2}}[.,](\d+)$', 1) AS frac, regexp_replace(x3, '(:\d{{2}})[.,]\d+$', '\1') AS x4 FROM t5),
t7 AS (SELECT *,
  regexp_extract_all(x4, '\d+') AS n,
  regexp_full_match(x4, '\d{{4}}[-:/]\d{{2}}[-:/]\d{{2}}[T ]\d{{1,2}}:\d{{2}}(:\d{{2}})?') AS iso,
  regexp_full_match(x4, '\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}} \d{{1,2}}:\d{{2}}(:\d{{2}})?') AS tail,
  regexp_full_match(x4, '(\w{{3}}, )?\d{{1,2}} [A-Za-z]{{3}} \d{{4}} \d{{2}}:\d{{2}}(:\d{{2}})?') AS mail,
  regexp_full_match(x4, '\d{{8}}[T_]\d{{6}}') AS dense, regexp_full_match(x, '\d+') AS number FROM t6),
t8 AS (SELECT *,
  CASE WHEN iso THEN n[1] WHEN tail THEN n[3] WHEN mail THEN n[2] WHEN dense THEN n[1][1:4] END::INT AS y,
  CASE WHEN iso THEN n[2]::INT WHEN tail THEN CASE WHEN mdy THEN n[1] ELSE n[2] END::INT
       WHEN mail THEN list_position({_months}, lower(regexp_extract(x4, ' ([A-Za-z]{{3}}) ', 1))) WHEN dense THEN n[1][5:6]::INT END AS mo,
  CASE WHEN iso THEN n[3] WHEN tail THEN CASE WHEN mdy THEN n[2] ELSE n[1] END WHEN mail THEN n[1] WHEN dense THEN n[1][7:8] END::INT AS dd,
  CASE WHEN iso OR tail THEN n[4] WHEN mail THEN n[3] WHEN dense THEN n[2][1:2] END::INT AS h0,
  CASE WHEN iso OR tail THEN n[5] WHEN mail THEN n[4] WHEN dense THEN n[2][3:4] END::INT AS mi,
  coalesce(CASE WHEN iso OR tail THEN n[6] WHEN mail THEN n[5] WHEN dense THEN n[2][5:6] END::INT, 0) AS s FROM t7),
t9 AS (SELECT *, CASE WHEN half IS NULL THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END END AS h FROM t8),
t10 AS (SELECT *, CASE WHEN y BETWEEN 1 AND 9999 AND mo BETWEEN 1 AND 12 AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59
  AND dd BETWEEN 1 AND day(last_day(make_date(y, mo, 1))) THEN make_timestamp(y, mo, dd, h, mi, s::DOUBLE) END AS local FROM t9),
t11 AS (SELECT *, coalesce(CASE off WHEN 'Z' THEN 0 ELSE CASE WHEN off[1] = '-' THEN -1 ELSE 1 END * (off[2:3]::INT * 3600 + right(off, 2)::INT * 60) END, CASE code {_letters} END) AS fix,
  timezone(coalesce(place, tz), local) AS late FROM t10),
t12 AS (SELECT *, late - INTERVAL 1 HOUR AS early FROM t11),
instants AS (
  SELECT id AS photo_id, field, CASE
    WHEN number THEN CASE WHEN length(x) <= 11 THEN x::BIGINT * 1000000 ELSE x::BIGINT * 1000 END
    WHEN fix IS NOT NULL THEN epoch_us(local) - fix::BIGINT * 1000000
    WHEN timezone(coalesce(place, tz), early) = local THEN epoch_us(early) ELSE epoch_us(late) END
    + CASE WHEN number THEN 0 ELSE rpad(coalesce(nullif(frac, ''), '0'), 6, '0')::BIGINT END AS utc_micros
  FROM t12 WHERE (number OR local IS NOT NULL) AND (code IS NULL OR fix IS NOT NULL))
"""
