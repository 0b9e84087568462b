"""Rows that operators must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is was that with house water people river school market winter garden letter morning village doctor paper teacher window street".split(),
    "de": "der die das und ist mit nicht auch haus wasser leute fluss schule markt winter garten brief morgen dorf arzt papier lehrer fenster strasse über".split(),
}


def prose(seed: int, sentences: int, lang: str = "en") -> str:
    """Sentences of random words; every seed gives other ones."""
    rng = np.random.RandomState(seed)
    letters, common = "abcdefghilmnoprstu", WORDS[lang]
    made = ["".join(letters[k] for k in rng.randint(0, len(letters), rng.randint(4, 9))) for _ in range(sentences * 3)]
    out = []
    for i in range(sentences):
        n = rng.randint(7, 13)
        words = [common[rng.randint(len(common))] if rng.rand() < 0.55 else made[rng.randint(len(made))] for _ in range(n)]
        out.append(" ".join(words).capitalize() + ".")
        out.append("\n" if rng.rand() < 0.2 else " ")
    return "".join(out).strip()


def edited(text: str, seed: int, share: float = 0.03) -> str:
    rng = np.random.RandomState(seed)
    return " ".join("changed" + str(rng.randint(99)) if rng.rand() < share else w for w in text.split(" "))


@lru_cache(maxsize=1)
def hard_rows() -> list[tuple[Any, ...]]:
    same = prose(1, 12)
    return [
        (1, same, "en", "a", len(same)),
        (2, same, "en", "b", len(same)),
        (2, same, "en", "b", len(same)),
        (3, edited(same, 5), None, None, None),
        (4, None, "en", "a", None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "de", "a", 4),
        (7, "word", "en", "a", 4),
        (8, "12345 !!! ...", "en", "a", 13),
        (9, prose(2, 4000, "de"), "de", "a", 0),
        (10, "x" * 200_000, "en", "a", 200_000),
        (11, prose(3, 20, "de"), "de", "c", 1),
        (12, prose(4, 20, "de"), "de", "c", 1),
        (13, prose(5, 20), "en", "c", 1),
        (None, same, "en", "a", 1),
        (None, None, None, None, None),
        (14, "Ünïcödé 日本語 \U0001f600 text", "de", "a", 1),
    ]


def hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


#: Names that operators might use themselves; ``text`` and ``doc_id`` come in the middle.
CLASHING = "id long, a string, c0 string, n long, sig long, doc_id long, node long, root long, text string, place long, list long, keep boolean, sigs string, `with space` string, group_id long, shard int, __doc long"


def clashing(spark: SparkSession) -> DataFrame:
    rows = [(i, "a", "c", 7, 8, r[0], 1, 2, r[1], 3, 4, True, "s", "w", 5, 6, 7) for i, r in enumerate(hard_rows())]
    return spark.createDataFrame(rows, CLASHING).repartition(2)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
