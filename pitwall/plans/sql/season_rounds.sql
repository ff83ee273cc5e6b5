-- Rounds, dates and entities on record per season, from the published view `results`.
SELECT Year,
       count(DISTINCT RoundNumber) AS qty_rounds,
       count(DISTINCT to_date(Date)) AS qty_dates,
       count(DISTINCT DriverId) AS qty_drivers
FROM results
WHERE Year BETWEEN :year_start AND :year_stop
GROUP BY Year
