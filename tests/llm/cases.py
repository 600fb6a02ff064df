"""Documents with the awkward cases that every operator must take."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

# Extra columns have names that operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, k long, s string, stats string, "
          "kept boolean, `class` string, size long, n_words string, winnow_row string, mix_row int, `odd.name` int")


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))


def awkward_rows() -> list[tuple]:
    long_text = "\n".join(sentence(500 + i, 300) for i in range(400))  # 120,000 words
    texts = [None, "", "  \n\t ", "one", "two words", sentence(1, 60), sentence(1, 60), sentence(1, 59) + " changed",
             sentence(2, 60) + "\n\n" + sentence(3, 80), "x\n" + sentence(3, 80) + "\ny", long_text,
             "é ñ 中文 \U0001f600 " * 8, "a" * 300_000, "rep rep rep rep rep rep rep rep rep rep rep rep"]
    extra = (7, "s", "st", True, "c", 5, "n", "w", 3, 4)
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t), *extra)
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]                                    # repeated rows
    rows += [(None, sentence(4, 40), None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
