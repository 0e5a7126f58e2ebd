"""Small tables with the odd cases every operator must take."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = {
    "en": "the and of to in that is with for as was on be at by this from or an".split(),
    "de": "der die das und ist nicht ein eine für auf dem den mit von zu sich im".split(),
    "fr": "le la les des et est dans une pour sur que qui avec par ne pas au du".split(),
}
ENDS = {"en": ["ing", "tion", "ly", "ed"], "de": ["ung", "keit", "lich", "schaft"], "fr": ["eau", "ment", "elle", "aient"]}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "size taken copies target order bucket fp component_id kept keep_id sha check part ids n_tokens score lang_pred labels of turn slot shard".split()


def prose(rng, lang, n):
    stems = ["walt", "mer", "ston", "bal", "rid", "fon", "gra", "pel", "tor", "sil", "dan", "kup"]
    words = []
    for k in range(n):
        word = rng.choice(WORDS[lang]) if rng.random() < 0.4 else rng.choice(stems) + rng.choice(stems) + rng.choice(ENDS[lang])
        words.append(word + (".\n" if k % 12 == 11 else "," if rng.random() < 0.05 else ""))
    return " ".join(words)


def documents(seed=1, n=120):
    """Plain documents, exact and near copies, and the odd rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.randint(20, 200))
        rows.append((k, text, lang, f"src{min(rng.randrange(9), 4)}", len(text)))
    base = rows[3][1]
    rows += [(1000 + k, base, "en", "src0", 0) for k in range(8)]
    rows += [(1100 + k, base.replace("\n", " \n\t"), "en", None, 0) for k in range(3)]
    rows += [(1200 + k, base + f" end{k}", "en", "é", 0) for k in range(6)]
    long = prose(rng, "de", 30_000)
    rows += [
        (2000, None, None, None, None), (2001, "", "en", "src1", 0), (2002, " \n\t\x0b\x0c\r ", "en", "src1", 7),
        (2003, long, "de", "src2", len(long)), (2004, "!!! 123 ???", "fr", "src9", 11), (2005, "x", "en", "src9", 1),
        (None, "no id is given here", "en", "src1", 19), (2006, "twice the same row", "en", "src1", 18),
        (2006, "twice the same row", "en", "src1", 18), (2007, "of of of of of of of", "en", "\U0001f600", 20),
        (2008, "  two  spaces   and more \n  end  ", "en", "src1", 20), (2009, "a\n\na\na\n b", "en", "", 9),
        (2010, "Licensed under CC BY-NC 4.0.", "en", "src1", 28), (2011, "café 日本 \U0001f600 <|endoftext|> It's WE'RE", None, "src3", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return documents()


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, odd_rows):
    """A folder of documents and pages, with further columns whose names operators use themselves."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    pages = [(k, f"http://a/{k % 5}", f"<p>{k % 30}</p>") for k in range(60)]
    pages += [(100, None, None), (101, "http://b", ""), (102, "http://c", None), (103, "http://long", "é" * 300_000), (7, "http://a/2", "<p>7</p>"), (None, "http://n", "<p>null</p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("header", F.lit("clash")).withColumn("sha", F.lit(1)).write.parquet(f"{folder}/pages.parquet")
    items = [(1, "der die das walter"), (2, odd_rows[3][1]), (3, None), (4, "!"), (5, "CAFÉ of of two"), (5, "x")]
    spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("clash")).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
