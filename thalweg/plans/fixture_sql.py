"""The fixture inputs as SQL, for the oracles (see FIXTURES.md)."""

CELLS = """SELECT CAST(FLOOR(o_orderkey/100) AS BIGINT) AS row_i, o_orderkey % 100 AS col_i,
  CASE WHEN o_custkey % 50 = 0 THEN NULL
       ELSE ROUND(3000 - 2*FLOOR(o_orderkey/100) + 0.5*ABS(o_orderkey%100 - 50) + o_totalprice/10000, 3) END AS z,
  CAST(FLOOR(o_orderkey/1500)*4 + FLOOR((o_orderkey%100)/25) AS BIGINT) AS basin_id
FROM orders"""
FLOW = """SELECT o_orderkey AS src, CAST(FLOOR(o_orderkey/100) AS BIGINT) AS row_i, o_orderkey % 100 AS col_i,
  5 + o_custkey % 3 AS fdir FROM orders"""
LINES = """SELECT user_id AS fid, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS vidx,
  CAST((event_id*37) % 1000 AS DOUBLE) AS x, value*2 AS y FROM events"""
PROFILES = """SELECT user_id AS basin_id, CAST(i AS BIGINT) AS idx, CAST(30.0*i AS DOUBLE) AS dist_m,
  ROUND(2500 - 8*i - 40*LN(1+i) + value/100, 3) AS elev, CAST(900.0*(1+i)*(1+i) AS DOUBLE) AS area_m2,
  CAST(CASE WHEN event_type='error' THEN NULL ELSE 900.0*(1+i)*(1+i) END AS DOUBLE) AS area_raw
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) AS i FROM events) t"""
PIXELS = """SELECT CAST(FLOOR(o_orderkey/100) AS BIGINT) AS row_i, o_orderkey % 100 AS col_i, (o_custkey*7) % 256 AS r,
  CAST(FLOOR(o_totalprice) AS BIGINT) % 256 AS g, (o_orderkey*13) % 256 AS b FROM orders"""
BASINS = """SELECT basin_id AS fid,
  CASE WHEN basin_id % 10 = 9 THEN '  ' ELSE CONCAT('BV ', CAST(basin_id AS VARCHAR)) END AS label,
  CAST((basin_id % 4)*250.0 AS DOUBLE) AS x_min, CAST((basin_id % 4)*250.0 + 250.0 AS DOUBLE) AS x_max,
  CAST(1000.0 - FLOOR(basin_id/4)*150.0 - 150.0 AS DOUBLE) AS y_min, CAST(1000.0 - FLOOR(basin_id/4)*150.0 AS DOUBLE) AS y_max
FROM (SELECT DISTINCT CAST(FLOOR(o_orderkey/1500)*4 + FLOOR((o_orderkey%100)/25) AS BIGINT) AS basin_id FROM orders) t"""
SEGMENTS = """SELECT CAST(c_nationkey AS BIGINT) AS basin_id, CAST(k AS BIGINT) AS seg_id,
  CAST((k % 97)*10.0 AS DOUBLE) AS start_x, CAST(FLOOR(k/97)*10.0 AS DOUBLE) AS start_y,
  CAST(CASE WHEN k=0 THEN -500.0 ELSE (FLOOR((k-1)/2) % 97)*10.0 + 0.5 END AS DOUBLE) AS end_x,
  CAST(CASE WHEN k=0 THEN -500.0 ELSE FLOOR(FLOOR((k-1)/2)/97)*10.0 + 0.5 END AS DOUBLE) AS end_y,
  CAST(100.0 + c_custkey % 50 AS DOUBLE) AS len_m
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) t"""
