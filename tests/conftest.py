"""One local session and a small corpus for all tests."""

import pytest

from throng.session import local_session
from throng.sources.records import COMMENT

NOW = 1_700_000_000.0


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def corpus(spark):
    """Six of one opinion, three of another, two apart; a tie of likes at the top."""
    said = [
        ("the blue harbour scene is the best moment in season two", 20, "@ann", 8, 0.0, ""),
        ("the blue harbour scene is the greatest moment of season two", 15, "@bo", 9, 0.0, ""),
        ("blue harbour scene best moment no debate", 12, "@cy", 10, 0.0, ""),
        ("the blue harbour scene really is the best moment here", 900, "@di", 11, 1.0, "🔥"),
        ("best moment is the blue harbour scene for sure", 1000, "@ed", 12, 1.0, "❤"),
        ("the blue harbour scene the best moment in this season", 73, "@fy", 13, 0.0, ""),
        ("The editing of this season is terrible and slow", 1000, "@gus", 20, -1.0, "😡"),
        ("editing is so slow and terrible this season", 60, "@hal", 21, -1.0, "💀"),
        ("terrible slow editing ruins the season", 40, "@ida", 22, 0.0, ""),
        ("I would love to see Quill meet Rasp one day, that would be so much fun", 13, "@jo", 8, 0.0, ""),
        ("Imagine Rasp being trained by Old Tern", 9, "", 8, 0.0, ""),
    ]
    rows = [(f"c{i}", t, a, n, f"{h} hours ago", NOW - 3600.0 * h, 0, False, e, v) for i, (t, n, a, h, v, e) in enumerate(said)]
    return spark.createDataFrame(rows, COMMENT).persist()
