-- Points per season and entity up to a season, from the published view `results`.
SELECT Year, DriverId, sum(Points) AS total_points
FROM results
WHERE Year <= :year_stop
GROUP BY Year, DriverId
