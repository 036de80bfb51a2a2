"""Small dimensions with fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Brand (none: generic), issue, then mean and deviation of parts, labor and total.
BENCHMARKS = (
    ("Honda", "Fuel pump issue", 800, 400, 1300, 200, 100, 350),
    ("Honda", "Battery drainage", 150, 80, 250, 50, 30, 80),
    ("Honda", "Transmission fluid leak", 600, 500, 1200, 150, 120, 300),
    ("Honda", "Oil leak", 200, 150, 400, 80, 60, 150),
    ("Honda", "Power steering failure", 700, 600, 1400, 200, 150, 400),
    ("Honda", "Alternator malfunction", 400, 250, 700, 100, 80, 200),
    ("Toyota", "Fuel pump issue", 750, 380, 1230, 180, 90, 320),
    ("Toyota", "Battery drainage", 140, 75, 235, 45, 28, 75),
    ("Toyota", "Transmission fluid leak", 580, 480, 1160, 140, 110, 280),
    ("Toyota", "Oil leak", 190, 140, 380, 75, 55, 140),
    ("Toyota", "Power steering failure", 680, 580, 1360, 190, 140, 380),
    ("Toyota", "Alternator malfunction", 380, 240, 680, 95, 75, 190),
    ("Chevrolet", "Fuel pump issue", 850, 420, 1380, 220, 110, 380),
    ("Chevrolet", "Battery drainage", 160, 85, 270, 55, 32, 90),
    ("Chevrolet", "Transmission fluid leak", 650, 520, 1280, 160, 130, 320),
    ("Chevrolet", "Oil leak", 220, 160, 420, 85, 65, 160),
    ("Chevrolet", "Power steering failure", 750, 640, 1500, 220, 160, 420),
    ("Chevrolet", "Alternator malfunction", 420, 260, 740, 110, 85, 210),
    ("Ford", "Fuel pump issue", 820, 400, 1330, 210, 105, 360),
    ("Ford", "Battery drainage", 155, 82, 260, 52, 30, 85),
    ("Ford", "Transmission fluid leak", 630, 510, 1250, 155, 125, 310),
    ("Ford", "Oil leak", 210, 155, 400, 82, 62, 155),
    ("Subaru", "Fuel pump issue", 780, 390, 1270, 195, 98, 340),
    ("Subaru", "Power steering failure", 720, 610, 1440, 205, 155, 410),
    ("Subaru", "Oil leak", 200, 148, 390, 78, 58, 148),
    ("Mazda", "Fuel pump issue", 760, 385, 1250, 190, 95, 335),
    ("Mazda", "Alternator malfunction", 390, 245, 695, 98, 78, 195),
    (None, "Fuel pump issue", 800, 400, 1300, 200, 100, 350),
    (None, "Battery drainage", 150, 80, 250, 50, 30, 85),
    (None, "Transmission fluid leak", 620, 500, 1220, 155, 125, 310),
    (None, "Oil leak", 200, 150, 400, 80, 60, 150),
    (None, "Power steering failure", 710, 600, 1420, 200, 150, 400),
    (None, "Alternator malfunction", 400, 250, 710, 100, 80, 200),
    (None, "Starter motor failure", 350, 280, 690, 90, 70, 180),
    (None, "AC compressor failure", 600, 400, 1100, 150, 100, 280),
    (None, "Radiator leak", 300, 250, 600, 80, 65, 160),
    (None, "Brake system issue", 400, 300, 770, 100, 80, 200),
)


def benchmarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i, *map(float, x)) for b, i, *x in BENCHMARKS], "brand string, issue_type string, avg_parts double, avg_labor double, avg_total double, std_parts double, std_labor double, std_total double")


def values_sql(rows) -> str:
    """Rows as the body of an SQL VALUES list."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
