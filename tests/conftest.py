import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from matchbook.runtime import SESSION_SETTINGS

    session = (
        SparkSession.builder.master("local[8]")
        .config(map=SESSION_SETTINGS)
        .appName("matchbook-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tour(spark):
    """Eight players, fifteen matches: two groups, two semi-finals, a final."""
    from matchbook.operators.graph import PropertyGraph

    # Players and matches of a small tournament.
    players = [
        (1, "Novak Djokovic", "SRB"),
        (3, "Roger Federer", "SUI"),
        (5, "Tomas Berdych", "CZE"),
        (7, "Kei Nishikori", "JPN"),
        (11, "Andy Murray", "GBR"),
        (15, "Stan Wawrinka", "SUI"),
        (17, "Rafael Nadal", "ESP"),
        (19, "David Ferrer", "ESP"),
    ]
    won = {
        "G1": [(1, 5), (1, 7), (3, 1), (3, 5), (3, 7), (7, 5)],
        "G2": [(11, 19), (15, 11), (15, 19), (17, 11), (17, 15), (17, 19)],
        "S": [(3, 15), (1, 17)],
        "F": [(1, 3)],
    }
    points = {"G1": 1, "G2": 1, "S": 5, "F": 11}
    matches = [
        (f"{stage}-{i}", src, dst, stage, points[stage], 1)
        for stage, pairs in won.items()
        for i, (src, dst) in enumerate(pairs)
    ]
    return PropertyGraph(
        spark.createDataFrame(players, "id long, name string, country string"),
        spark.createDataFrame(
            matches,
            "match_id string, src long, dst long, match_type string, points int, head2head int",
        ),
    )


def rows(df):
    return [tuple(row) for row in df.collect()]
