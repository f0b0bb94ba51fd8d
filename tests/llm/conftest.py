import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import sentence  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for themselves.
CLASHES = ["size", "shard", "slot", "key", "row", "a", "b", "fp", "root", "copies", "n", "lines", "chunk", "score",
           "lang_pred", "held_out", "tokens", "ids", "spans", "kept", "h"]



@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(4)
    long = "\n".join(sentence(rng, 60) for _ in range(400))
    rows = [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, " \n\t ", None, None, 4), (None, "no id here", "en", "s2", 10),
        (None, None, None, None, None), (4, long, "en", "s2", len(long)), (5, "ßtraße Ünïcode 日本語 \U0001f600 naïve", "de", "s3", 9),
        (6, "same words again and again", "en", "s1", 26), (7, "same words again and again", "en", "s2", 26),
        (8, "1234 5678 --- ###", "en", "s3", 17), (9, "password = hunter2hunter2", "en", "s3", 25),
        (10, "x\x00y\x0bz\x0cw", "fr", "s1", 7), (11, "un deux", "fr", "s1", 7), (12, "one", "en", "s4", 3),
    ]
    return rows + [(13, "a row that repeats", "en", "s5", 18)] * 5 + [(14, "the same id", "en", "s5", 11), (14, "but another text", "en", "s5", 16)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_rows):
    schema = DOCS + "".join(f", {c} string" for c in CLASHES) + ", `dotted.name` string, extra map<string,int>"
    return spark.createDataFrame([r + ("x",) * (len(CLASHES) + 1) + ({"k": 1},) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
