import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "wordy " * 30_000 + "Released under the MIT License.\n" + "x" * 50_000

TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."),
    (3, ""),
    (4, None),
    (5, " \n\t "),
    (6, "one"),
    (7, LONG),
    (8, "Écoute, ÄÖÜ ñandú 東京 \U0001f600 mail me@example.org or +1 (555) 010-4477, card 4111 1111 1111 1111."),
    (None, "a row without an id, from 10.0.0.255"),
    (None, None),
    (9, "Licensed under the Apache License, Version 2.0.\npassword=9f8e7d6c5b4a39281706 here"),
    (9, "two texts of one id"),
    (10, "This work is licensed\nunder the GNU General Public\nLicense version 2.\n\nThis work is licensed under the GNU Lesser General Public License"),
    (11, "Licensed under a Creative Commons\nAttribution 4.0 International License. " + "word " * 90 + "\nLicensed under CC BY-NC 4.0"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """NULLs, empty and long texts, repeated rows and ids, and columns that clash with inner names."""
    rows = [(i, t, None, "s", None, "r", 1, "k", None, 0.5) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h int, "
        "key string, words array<string>, score double")


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (8, None, 1), (6, 0, 0), (7, 1, 1), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
