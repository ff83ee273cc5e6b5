-- The entity with most points of each season up to one, from the published view `results`.
WITH totals AS (
  SELECT Year, DriverId, sum(Points) AS total_points
  FROM results
  WHERE Year <= :year_stop
  GROUP BY Year, DriverId
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Year ORDER BY total_points DESC NULLS LAST, DriverId) AS rank_driver
  FROM totals
)
SELECT Year, DriverId, total_points, rank_driver
FROM ranked
WHERE rank_driver = 1
