import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empty and long texts, copies, near copies, ties, repeated rows."""
    rng = np.random.default_rng(3)
    vocabulary = np.array(["w%d" % i for i in range(400)])

    def prose(n):
        return " ".join(rng.choice(vocabulary, n).tolist())

    rows = [(i, prose(int(rng.integers(3, 160)))) for i in range(120)]
    passage = prose(70)
    for i in range(120, 150):
        rows.append((i, prose(20) + " " + passage + "\n" + prose(15)))
    base = prose(90).split()
    for i in range(150, 190):
        near = list(base)
        for at in rng.choice(90, 2, replace=False):
            near[at] = "x%d" % rng.integers(1000)
        rows.append((i, " ".join(near)))
    rows += [(190 + i, rows[5][1]) for i in range(25)]
    rows += [(220, None), (221, ""), (222, " \n\t"), (223, "one"), (224, "one"), (None, prose(60)), (None, None)]
    rows += [(225, prose(9000)), (226, "it's über <|endoftext|> 日本 1,5"), (227, "A b C d E f"), (228, "a B c D e F")]
    rows += [rows[7], rows[7], (7, "another text with the same id")]
    sources = ["s1", "s2", "s1", None, "ä", "s1", "z"]
    return [(d, t, "en", sources[k % 7], None if t is None else len(t)) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus, SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
